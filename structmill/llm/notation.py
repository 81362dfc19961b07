"""Local grammars: regular patterns over token classes, in which each bracket group is one symbol.

What stands in a pair of brackets is matched, when the pair closes, against the kinds of groups of its language
(arguments, block, type body, ...), and goes on in the enclosing text as one symbol that says which kinds it can be. So no pattern ever looks into a group, and equal groups are matched once.

Notation of a rule: ``name : body``. 'x' is the token x, upper-case names are token classes, other names are rules;
P.KIND, A.KIND and B.KIND are groups in round, square and curly brackets, I.KIND indented blocks; ( ) | * + ? as usual,
!( ) what must not follow, $ the end of the group. Choices are ordered and never reconsidered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

_ITEM = re.compile(r"\s*(?:'(?P<token>[^']+)'|(?P<group>[PABI])\.(?P<kind>\w+)|(?P<class>[A-Z]+\b)|(?P<rule>[a-z]\w*)|(?P<sign>!\(|[()|*+?$]))")
_MARK = {"P": "\ue000", "A": "\ue001", "B": "\ue002", "I": "\ue003"}


class Grammar:
    """rules: the notation above; the rule of a group kind is its name in lower case with its bracket: p_args.

    kinds: per bracket the names of its kinds. kinds ending in ``~`` see line ends, others don't. A group's symbol is a
    mark of its bracket and, for each kind, 1 or 0.
    classes: token class -> the tokens in it (besides ID, NUM, STR and NL, which a lexer gives itself).
    """

    def __init__(self, rules: str, kinds: dict[str, str], start: str, classes: dict[str, str]):
        self.chars: dict[str, str] = {"ID": "i", "NUM": "n", "STR": "s", "NL": "\n"}
        self.kinds = {b: [k.rstrip("~") for k in names.split()] for b, names in kinds.items()}
        self.lines = {b: [k.endswith("~") for k in names.split()] for b, names in kinds.items()}
        self.start = start
        self._classes = classes
        bodies = {}
        for line in filter(None, re.sub(r"\n[ ]+", " ", rules).split("\n")):
            name, _, body = line.partition(" : ")
            bodies[name.strip()] = body
        for words in classes.values():
            for w in words.split():
                self._char(w)
        self._short = {}
        for _ in range(8):  # small rules are written out where they are used: a call costs more than they do
            for n, b in bodies.items():
                if n not in self._short and all(r in self._short for r in re.findall(r"(?<![\w.'])[a-z]\w*(?![\w'])", re.sub(r"'[^']+'", "''", b))) and len(x := self._body(b)) < 160:
                    self._short[n] = f"(?>{x})"
        defined = "".join(f"(?P<{n}>(?>{self._body(b)}))" for n, b in bodies.items() if n not in self._short)
        # one pattern for all rules that are asked for: the first character says which
        self._asked = {n: chr(0xF000 + i) for i, n in enumerate(n for n in bodies if n[:2] in ("p_", "a_", "b_", "i_") or n in (start, "hole"))}
        choices = "|".join(f"{mark}{self._short.get(n) or f'(?&{n})'}" for n, mark in self._asked.items())
        self._pattern = regex.compile(f"(?(DEFINE){defined})(?:{choices})", regex.S)
        self.group = lru_cache(maxsize=20_000)(self._group)

    def _char(self, token: str) -> str:
        return self.chars.setdefault(token, chr(0x4E00 + len(self.chars)))

    def _members(self, bracket: str, kind: str) -> str:
        bit, n = self.kinds[bracket].index(kind.lower()), len(self.kinds[bracket])
        return f"(?:{_MARK[bracket]}{'.' * bit}1{'.' * (n - 1 - bit)})"

    def _body(self, body: str) -> str:
        out, at = [], 0
        while at < len(body.rstrip()):
            m = _ITEM.match(body, at)
            if not m:
                raise ValueError(f"grammar: {body[at:]!r}")
            at = m.end()
            if m["token"]:
                out.append(regex.escape(self._char(m["token"])))
            elif m["group"]:
                out.append(self._members(m["group"], m["kind"]))
            elif m["class"]:
                name = m["class"]
                if name == "ANY":
                    out.append(".")
                else:
                    out.append("[" + "".join(regex.escape(self._char(w)) for w in self._classes[name].split()) + "]" if name in self._classes else regex.escape(self.chars[name]))
            elif m["rule"]:
                out.append(self._short.get(m["rule"]) or f"(?&{m['rule']})")
            else:
                out.append({"(": "(?>", "!(": "(?!", "*": "*+", "+": "++", "?": "?+"}.get(m["sign"], m["sign"]))
        return "".join(out)

    def matches(self, rule: str, content: str) -> bool:
        return self._pattern.fullmatch(self._asked[rule] + content) is not None

    def _group(self, bracket: str, content: str) -> str | None:
        """The symbol of a group with this content; None if it can be nothing."""
        flat = content.replace("\n", "")
        fits = "".join("01"[self.matches(f"{bracket.lower()}_{kind}", content if lines else flat)] for kind, lines in zip(self.kinds[bracket], self.lines[bracket]))
        return _MARK[bracket] + fits if "1" in fits else None
