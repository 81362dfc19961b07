import os
import warnings
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from structmill.llm.lexing import effect, joined, parses, pieces, prepared, states
from structmill.llm.p3_syntax import invalid_rates, runs, syntax_flags
from structmill.llm.syntax import language_of, valid

GOOD = {
    "python": ["", "# x\n", "def f(a, *, b: int = 1) -> str:\n    '''d'''\n    return f'{a}'\n", "async def f():\n    async with a as b: pass\n", "match x:\n    case [1, *r]: pass\n"],
    "javascript": [
        "", "// only\n/* c */", "import a, { b as c } from 'x';\nexport default class extends B { #p = 1; static async *g() {} get x() { return 1 } }", "const {a, ...r} = o, [x = 1, , y] = z;\nlet f = async (q) => ({...q});",
        "for (const [k, v] of Object.entries(o)) { if (!k) continue; else break }\nlabel: for (;;) {}", "x = a ? b : c ? d : e\ny = /[/\"]+/g.test(s)\n;[1, 2].map(n => n * 2)", "const t = `a ${b + `c ${d}`} e`;", "switch (a) { case 1: default: f() }\ntry { g() } catch { } finally { }",
        "a?.b?.[c]?.(d) ?? e", "do x++; while (x < 5)\nwhile (1) {}", "const el = <div a={b} {...c}>hi {x}<br/></div>;", "export * from 'm';\nexport { a as b };\nif (a) b(); else c();", "var f = function* () { yield* g(); }\nnew Foo\nnew a.B(1).c", "/* <<<<<<< HEAD\n=======\n>>>>>>> */ a()",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D { readonly [k: string]: T; m?(x: number): void; new (a: any): A }", "type F = (a: string, ...r: number[]) => Promise<Map<string, number[]>>;\ntype U = 'a' | 1 | { [K in keyof T]?: T[K] };",
        "abstract class A<T> implements I { constructor(private readonly x: number) { super() } abstract m(): void; static y?: string = 'a'; }", "enum E { A = 1, B }\nnamespace N.M { export const a = 1 }\ndeclare module 'x' { }", "function f(a: string): a is 'x';\nfunction f(a: any) { return <any>1 as unknown as T }",
        "const x = y as const;\nlet z = w!.v;\nimport type { T } from 't';\nfoo<string>(a);", "export const g = async <T,>(x: T): Promise<T> => { return x; };", "let a: [x: number, y?: string] | null = null",
    ],
    "go": [
        "package p\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n", "package p\n\ntype T[K comparable] struct {\n\ta, b int `json:\"x\"`\n\t*E\n}\n\ntype I interface {\n\tM(a int) (int, error)\n\t~int | string\n}\n",
        "package p\n\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn\n\t} else if x {\n\t}\n\tfor i := range 10 {\n\t}\n\tfor ; ; {\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\ta, b = b, a\n\treturn f(T{a: 1}, []int{1, 2,}), nil\n}\n",
        "package p\n\nvar x = map[string][]int{\"a\": {1}, \"b\": {}}\nconst (\n\tA = iota\n\tB\n)\n", "package p\n\nfunc f() {\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\tcase c <- 1:\n\t}\nL:\n\tfor {\n\t\tbreak L\n\t}\n\tdefer g()\n\tx := a[1:2:3]\n\tx[0]++\n}\n",
    ],
    "java": [
        "package a.b;\nimport static x.Y.*;\nimport java.util.List;\n@A(b = 1, c = {1, 2}) public final class C<T extends D & E> extends F<T> implements G { }", "class A { static { x(); } int[] a = {1, 2}, b[]; A() throws E { this(1); } <T> T f(final List<? extends T>... x) { return null; } }",
        "enum E { A(1) { int f() { return 1; } }, B; private int x; E(int... y) { } }", "record R(int a, String b) { R { } }", "class A { void f() { for (int i = 0, j = 1; i < j; i++) ; for (String s : xs) { } try (var x = y(); z) { } catch (A | B e) { } finally { } int y = switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; switch (q) { case A: break; default: } } }",
        "class A { Runnable r = () -> { }; F g = (a, b) -> a + b; G h = String::valueOf; int x = (int) y + -(z); Object o = new Object() { }; int[][] m = new int[3][]; boolean b = o instanceof String s && s.length() > 1; String t = \"\"\"\n a \"x\" \"\"\"; }", "interface I { int f(int q); default void g() { } }",
    ],
    "rust": [
        "#![allow(x)]\nuse std::{fs, io::{self, Read as R}};\npub mod m { pub(crate) const A: &[&str] = &[\"a\"]; }\nstatic mut X: i32 = 1;", "impl<'a, T: Clone + 'a> Trait<T> for S<'a, T> where T: Fn(i32) -> i32 { type O = T; fn f(&mut self, (a, b): (i32, i32)) -> Option<Box<dyn Fn() -> i32>> { None } }",
        "fn f() -> i64 { let Some(x) = y else { return 1; }; if let Some(z) = a && b { } match v { 1 | 2 => 3, n @ 3..=5 if n > 4 => { 6 } _ => 7, }; let c = |a: i32, &b| a + b; for i in 0..n { break; } x as i64 + vec![1, 2].len()? }", "enum E<T> { A, B(T, i32), C { x: i32 }, D = 4 }\nstruct S;\nstruct T(pub i32, u8);",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nfn g() { println!(\"{}\", x); loop { } }", "async fn f<const N: usize>(x: [u8; N]) -> impl Iterator<Item = u8> + '_ { x.iter().map(|b| b).collect::<Vec<_>>() }", "fn f() { let s = S { a, b: 1, ..Default::default() }; let t = r#\"a \"b\" \"#; 'l: while x < 3 { continue 'l; } }",
    ],
}
BAD = {
    "python": ["def f(:\n", "print 'a'\n", "if x:\nfoo()\n", "x = (1,\n", "<<<<<<< HEAD\na = 1\n", "x = “a”\n", "a\x00b"],
    "javascript": ["function f(a) {", "a b", "let x = ;", "f(a: any)", "import { a } fro 'x'", "<<<<<<< HEAD\na()\n=======\n", "x = 'a", "interface A { }", "{\"a\": 1, \"b\": [2]}", "name: x\nversion: 7\nsteps:\n  - run: make x\n", "def f(x):\n    return x\n", "f(}", "a => {x: 1, y: 2}", "return “x”;"],
    "typescript": ["interface A { x: }", "let x: = 1", "class { m( }", "function f(a: any): { }}", "type = ;"],
    "go": ["func f() {}\n", "package p\n\nfunc f( {\n}\n", "package p\n\nx := 1\n", "package p\n\nfunc f() {\n\treturn len(“a”)\n}\n", "package p\n\nfunc {{ a.b }}() {\n}\n", "package p\n\nfunc f() { a b }\n"],
    "java": ["class A {", "class A { int f( { } }", "x = 1;", "class A { void f() { return 1 } }", "class A { int x = ; }", "public function f() { }"],
    "rust": ["fn f() {", "fn f(a i64) { }", "let x = 1;", "fn f() { let x = ; }", "struct S { a: }", "def f(x):\n    pass\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid(language):
    assert [t for t in GOOD[language] if not valid(t, language)] == []


@pytest.mark.parametrize("language", BAD)
def test_invalid(language):
    assert [t for t in BAD[language] if valid(t, language)] == []


def test_suffixes():
    assert [language_of(p) for p in ("a/b.PY", "x.tsx", "x.mjs", "noext", "", None)] == ["python", "tsx", "javascript", None, None, None]


PARTS = {
    "python": ["(", ")", "{", "}", "[", "]", "'''", 'f"""', '"""', "f'{", "{{", '"a"', "# x\n", "a", "\n", "\n  ", ":", "'"],
    "javascript": ["(", ")", "{", "}", "/*", "*/", "`", "${", '"a"', "// x\n", "a", "\n", "<b>", "</b>", "<c x={", "/>", "/r/", ";"],
    "tsx": ["(", ")", "{", "}", "/*", "*/", "`", "${", "a", "\n", "<b>", "</b>", "<c ", "/>", ";", ":"],
    "typescript": ["(", ")", "{", "}", "/*", "*/", "`", "${", "a", "\n", "<", ">", "=>", ";", ":"],
    "go": ["(", ")", "{", "}", "/*", "*/", "`", '"a"', "// x\n", "a", "\n"],
    "java": ["(", ")", "{", "}", "/*", "*/", '"""', '"a"', "// x\n", "a", "\n", ";"],
    "rust": ["(", ")", "{", "}", "/*", "*/", '"', 'r#"', '"#', "// x\n", "a", "\n", "'a", ";"],
}


def pieced(text, language, size, tree=False):
    """The effect of a text from its pieces, joined from the left or pair by pair."""
    text = prepared(text, language)
    known = states(text, language)
    found = [effect(part, begin, language, known) for begin, part in pieces(text, language, size)]
    while tree and len(found) > 1:
        found = [reduce(lambda a, b: joined(a, b, language), found[i : i + 2]) for i in range(0, len(found), 2)]
    return reduce(lambda a, b: joined(a, b, language), found)


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(sorted(PARTS)).flatmap(lambda lang: st.tuples(st.just(lang), st.lists(st.sampled_from(PARTS[lang]), max_size=40))), st.integers(1, 30))
def test_pieces_join_to_the_whole_in_any_order(case, size):
    language, parts = case
    text = "".join(parts)
    whole = pieced(text, language, len(text) + 2)
    assert pieced(text, language, size) == pieced(text, language, size, tree=True) == whole


@pytest.mark.parametrize("language", GOOD)
def test_pieces_change_no_verdict(language):
    for name in ("tsx", language) if language == "typescript" else (language,):
        for text in GOOD[language] + BAD[language]:
            assert len({parses(pieced(text, name, size, tree), name) for size in (3, 17, 10_000) for tree in (True, False)}) == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_files_at_any_piece_size_and_pythons_own_parser():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/source_files.parquet", columns=["file_id", "file_path", "content"]).to_pylist()
    flags = {}
    for key, (language, text) in {r["file_id"]: (language_of(r["file_path"]), r["content"] or "") for r in rows}.items():
        verdicts = {parses(reduce(lambda a, b: joined(a, b, language), runs(text, language, piece=size, run=3)), language) for size in (64, 1024, 65_536)}
        assert len(verdicts) == 1
        flags[key] = verdicts.pop()
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    compile(text, "file", "exec", dont_inherit=True)
                    want = True
                except (SyntaxError, ValueError):
                    want = False
            assert flags[key] == want, key
    assert 0 < sum(flags.values()) < len(flags)


LINES_GO_ON = ["a\n  .b()\n  .c()\n", "x = a\n  && b\n  ? c\n  : d\n", "if (a)\n{\n b()\n}\nelse\n{ c() }\n", "function f()\n{\n}\n", "let y\n  = 3\n", "class A\nextends B\n{\n  m()\n  { }\n}\n", "switch (a)\n{ default: }\ntry\n{ }\ncatch (e)\n{ }\n", "const a = 1\nlet b = html`a ${b} c`\na()\n{ b() }\n"]


def test_script_lines_that_go_on():
    for language in ("javascript", "typescript", "tsx"):
        assert [t for t in LINES_GO_ON if not valid(t, language)] == []
        assert not valid("a b\n", language) and not valid("function f()\n", "javascript")
    assert valid("type A =\n  | 'a'\n  | 'b'\ninterface B\n{\n  c: 1\n}\n", "typescript")


OVER_LINES = {
    "rust": ["/* a /* b */ ( c */ fn f() {}\n", 'fn f() { g("a\n(b"); }\n', 'fn f() { g(r#"a\n("b"#); }\n'],
    "javascript": [
        "const e = <p>one (two</p>;\n", "const e = (\n  <ul a='x>y' {...b}>\n    {c.map((d) => (\n      <li key={d}>it's {d} :(</li>\n    ))}\n  </ul>\n);\n", "const t = `a ${b.map(\n  (c) => {\n    return `${c}(`;\n  }\n)} }`;\n",
        "x = a / b;\ny = c\n  / d / e;\n", 'const e = <><A /><B.C d="(" /></>;\n', "f(a /* b\nc */ / d);\n",
    ],
    "tsx": ["const f = <T,>(x: T) => x;\nconst e = <p>one (two</p>;\n", "const f = <T extends U>(x: T): T => x;\n"],
    "python": ['x = f"{d["("]}"\n', "x = f'''{\n  a(\n    f'{b}(')\n} {{ {c:>{w}} ('''\n", "x = {\n  'a': 1,\n}\n", "x = 'a\\\n('\n", "if a:\n\tif b:\n\t\tc()\n\td()\n"],
    "java": ['class A { String s = """\n  (\n  """; }\n'],
    "go": ["package p\n\nvar s = `\n(\n`\n"],
}
CUT_OPEN = {
    "rust": ["/* a /* b */ fn f() {}\n"],
    "javascript": ["const e = <p>one</p></p>;\n", "const e = <p>{a(}</p>;\n", "const t = `a ${b(} c`;\n"],
    "python": ["x = f'{a'\n", "x = f'''{a(}'''\n", "if a:\n    b()\n  c()\n", "  x = 1\n"],
}


def test_what_goes_on_over_lines():
    for cases, want in ((OVER_LINES, True), (CUT_OPEN, False)):
        for language, texts in cases.items():
            for text in texts:
                for size in (1, 5, 10_000):
                    assert parses(pieced(text, language, size), language) == want, (language, text, size)


FILES = "file_id bigint, repo string, file_path string, content string, ingested_at timestamp"


def test_job(spark):
    long_good = "def f():\n    '''" + "x\n" * 3000 + "'''\n    return (1)\n" * 1
    rows = [(1, "r", "a.py", "x = 1\n", None), (1, "r", "a.py", "x = 1\n", None), (2, "r", "b.js", "f(", None), (3, "r", "c.go", None, None), (4, "r", "d.txt", "(", None), (None, "r", "e.py", "(", None), (5, None, "f.py", long_good, None), (6, "r", "g.js", "a(/* " + "y\n" * 3000, None), (7, "r", "h.py", "", None), (8, "r", "i.py", "x = (\r\n1)\r\n", None)]
    df = spark.createDataFrame(rows, FILES).selectExpr("*", "1 AS key", "2 AS text", "3 AS n")
    want = {1: False, 2: True, 3: False, 5: False, 6: True, 7: False, 8: False}
    assert {r.file_id: r.invalid for r in syntax_flags(df).collect()} == want
    assert {r.file_id: r.invalid for r in syntax_flags(df, piece=100, run=2).collect()} == want
    assert syntax_flags(spark.createDataFrame([], FILES)).count() == 0
    total = invalid_rates(df).where("repo IS NULL AND language IS NULL").first()
    assert (total.files, total.invalid) == (7, 2)


def test_size_changes_no_result(spark):
    pad = "# " + "x" * 150 + "\n"
    wide = "a" * 120
    texts = {
        "a.py": pad + "x = f\"{d[\"(\"]}\"\n" + pad, "b.py": "x = '" + wide + "\\\n(" + wide + "'\n", "c.py": pad + "x = (\n" + pad, "d.js": "var s = \"" + wide + "\\\n( " + wide + "\\\n[" + wide + "\";\nf(s);\n",
        "e.ts": "let s = '" + wide + "\\\n} b';\n" + "// " + wide + "\n", "f.js": "var s = \"" + wide + "\\\n(\";\nf(" + wide + ";\n", "g.ts": "let s = '" + wide + "\\\\';\n" + "f({});\n// " + wide + "\n", "h.js": "f(); // " + wide + "\\\ng(\n",
    }
    df = spark.createDataFrame([(i, "r", p, t, None) for i, (p, t) in enumerate(texts.items())], FILES)
    got = [{r.file_id: r.invalid for r in syntax_flags(df, piece=n).collect()} for n in (100, 1 << 16)]
    assert got[0] == got[1] == {i: p in ("c.py", "f.js", "h.js") for i, p in enumerate(texts)}
