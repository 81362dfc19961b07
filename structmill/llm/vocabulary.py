"""Suffixes, reserved words and operators of the languages; all fixed values."""

from __future__ import annotations


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Languages by suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".rs": "rust"}

_JS = (
    "var let const function class extends return if else for while do switch case default break continue try catch finally throw new delete typeof void in of "
    "instanceof import export from as async await yield static get set this super null true false debugger with"
)
_TS = _JS + " interface type enum namespace module declare abstract readonly public private protected implements keyof is satisfies override infer unique asserts"
#: Reserved and contextual words.
WORDS = {
    "python": _words(
        "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return "
        "try while with yield match case type"
    ),
    "javascript": _words(_JS),
    "typescript": _words(_TS),
    "tsx": _words(_TS),
    "go": _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"),
    "java": _words(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
        "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void "
        "volatile while true false null record sealed permits yield when"
    ),
    "rust": _words(
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true "
        "type unsafe use where while union"
    ),
}
_JS_SIGNS = "{ } ( ) [ ] ; , < > <= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... @ #"
#: Operators. Those that begin with a greater sign are left to the grammars, as it also closes type arguments.
SIGNS = {
    "python": "+ - * / // % @ ** << >> & | ^ ~ < > <= >= == != = += -= *= /= //= %= @= &= |= ^= >>= <<= **= -> := . ... , ; : !",
    "javascript": _JS_SIGNS,
    "typescript": _JS_SIGNS,
    "tsx": _JS_SIGNS,
    "go": "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... , ; . :",
    "java": "; , . ... @ :: = > < ! ~ ? : -> == <= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<=",
    "rust": "+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= = == != > < <= @ . .. ... ..= , ; : :: -> => # $ ? ~",
}
