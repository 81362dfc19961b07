import pytest

from structmill.llm.p5_pairs import documented_pairs
from structmill.llm.pairs import documented_functions, trivial

FOUND = {
    "python": ('class A:\n    """Not a function."""\n    @dec\n    async def f(\n        self,\n        a=")",\n    ) -> "x:y":\n        r"""Does it\n        well."""\n        def g(): "Inner doc string."\n\ndef h():\n    # c\n\n    "One " "two."\n\ndef i():\n    f"""no {x}"""\n\ndef j():\n    "a" + b\n\ndef k():\n    b"no"\n\ns = """\ndef z():\n    \'doc\'\n"""\n', {(4, "f", "method"), (10, "g", "method"), (12, "h", "function")}),
    "javascript": ('/** File words. */\nimport a from "a";\n\n/** Adds two\n * numbers. */\n\n// note\nexport async function add(a = "/** x */", b) { return `}`; }\n/** Arrow doc. */\nexport const arrow = async (x) => {\n  /** Inner doc. */\n  function inner() {}\n};\n/** Class. */\nclass K {\n  /** Runs it. */\n  static async run(a) { }\n  /** If doc. */\n  x = 1;\n}\n/* plain */\nfunction p() {}\nconst s = "/** no */ function q() {}";\n/** e */ const e = x => x + 1;\n', {(8, "add", "function"), (10, "arrow", "function"), (12, "inner", "function"), (17, "run", "method"), (24, "e", "function")}),
    "typescript": ('/** Typed. */\nexport const t = async (a: Map<string, number>, b?: (x: any) => void): Promise<any> => {\n};\nabstract class A {\n  /** No body. */\n  abstract m(): void;\n  /** Body. */\n  @dec({ a: 1 })\n  private n<T>(x: { a: T }): { b: T }[] { return []; }\n}\n/** Overload. */\nfunction o(a: string): void;\nfunction o(a: any): void { }\n', {(2, "t", "function"), (9, "n", "method")}),
    "go": ('package p\n\n// Run runs.\n// More.\nfunc Run(a func(int) error) (x int, err error) {\n}\n\n// Lost.\n\nfunc Lost() {}\n\n/*\nBlock doc.\n*/\nfunc (t *T[K]) M() map[string]interface{} { return nil }\n\n// No body.\nfunc asm(a int) int\n\nvar s = `\n// x\nfunc y() {}\n`\n', {(5, "Run", "function"), (15, "M", "method")}),
    "java": ('/** Class. */\nclass A {\n    /** Makes. */\n    public A() { }\n\n    /** Runs. */\n\n    @SuppressWarnings("a)")\n    // c\n    public static <T> List<T> run(int a) throws E { return "{"; }\n    /** None. */\n    abstract int none();\n    @Override /** Late. */\n    int late() { return 1; }\n    /** Field. */\n    int x = f();\n    // line\n    void line() { }\n}\n', {(4, "A", "method"), (10, "run", "method")}),
    "rust": ('//! File.\n\n/// Adds.\n/// # Examples\n#[inline]\npub fn add<T: Into<i64>>(a: T) -> Option<[i64; 2]> where T: Copy { None }\n\nimpl S {\n    /** Block. */\n\n    pub(crate) async fn m(&self) {}\n    // plain\n    fn p(&self) {}\n    //// four\n    fn q() {}\n    #[doc = "Attr."]\n    fn r() {}\n    fn inner() {\n        //! Inside.\n    }\n}\ntrait T {\n    /// Sig.\n    fn sig(&self);\n    /// Default.\n    fn d(&self) { }\n}\n', {(6, "add", "function"), (11, "m", "method"), (17, "r", "method"), (18, "inner", "method"), (26, "d", "method")}),
}


@pytest.mark.parametrize("language", FOUND)
def test_what_is_documented(language):
    text, want = FOUND[language]
    for ends in ("\n", "\r\n"):
        assert {(p.line, p.name, p.kind) for p in documented_functions(text.replace("\n", ends), language)} == want


def test_signature_and_text():
    p = next(documented_functions(FOUND["javascript"][0], "javascript"))
    assert p.documentation == "Adds two\nnumbers." and p.signature.startswith("export async function add(")


@pytest.mark.parametrize("doc", ["", "...", "-", "TODO", "TODO: write documentation for this function", "FIXME: document", "XXX add docs", "tbd", "N/A", "Description.", "docstring", "@param value", "@returns", ":param value:", "eslint-disable-next-line complexity", "noqa: D103", "load user", "Loads the user.", "The load user function.", "LoadUser ...", "{@inheritDoc}", "Auto-generated method stub", "@param x the value\n@return y"])
def test_trivial(doc):
    assert trivial(doc, "load_user", "javascript" if "@" in doc else "python")


@pytest.mark.parametrize("doc", ["Loads the user or fails.", "Needs the lock to be held.", "Adds a row to the table.", "No rows give zero.", "Empty input gives nothing.", "Description of the user as stored."])
def test_not_trivial(doc):
    assert not trivial(doc, "load_user", "python")


def test_job(spark):
    schema = "file_id bigint, repo string, file_path string, content string, ingested_at timestamp"
    good = "def f():\n    'Says what it does.'\n\ndef g():\n    'TODO'\n"
    rows = [(1, "r", "a.py", good, None), (1, "r", "a.py", good, None), (2, "r", "b.py", good + "x = (", None), (3, "r", "c.py", "", None), (4, "r", "d.py", None, None), (5, "r", "e.txt", good, None), (None, "r", "f.py", good, None), (6, "r", "g.py", "x = 1\n" * 40000 + good, None)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS line", "2 AS name")
    assert sorted((r.file_id, r.line) for r in documented_pairs(df).collect()) == [(1, 1), (6, 40001)]
    assert documented_pairs(spark.createDataFrame([], schema)).count() == 0


def test_the_code_is_the_whole_function():
    code = lambda text, language: [p.code for p in documented_functions(text, language)]
    assert code('class A:\n    def f(a):\n        """Says it."""\n        s = """\nnot the end\n"""\n        if a:\n\n            # c\n            return (\n1)\n        return s\n\n    x = 1\n', "python") == ['def f(a):\n        s = """\nnot the end\n"""\n        if a:\n\n            # c\n            return (\n1)\n        return s']
    assert code("/** Doc. */\nconst f = (a) =>\n  a.map((x) => ({ x, y: [1, 2] }))\n    .filter(Boolean);\ng();\n", "javascript") == ["const f = (a) =>\n  a.map((x) => ({ x, y: [1, 2] }))\n    .filter(Boolean)"]
    assert code('/** Doc. */\nfunction f() { const s = "}"; return `${"}"}}`; }\nrest();\n', "typescript") == ['function f() { const s = "}"; return `${"}"}}`; }']
    assert code('class A {\n  /** Doc. */\n  int f() { char c = \'}\'; /* } */ return 1; }\n  int g() { }\n}\n', "java") == ["int f() { char c = '}'; /* } */ return 1; }"]
    assert code("// Doc of f.\nfunc f() int {\n\ts := `}`\n\treturn 1\n}\n\nvar x = 1\n", "go") == ["func f() int {\n\ts := `}`\n\treturn 1\n}"]
    assert code('/// Doc.\nfn f() -> i32 { let s = "}"; 1 }\nfn g() {}\n', "rust") == ['fn f() -> i32 { let s = "}"; 1 }']


def test_a_comment_behind_an_annotation_of_any_length_documents_nothing():
    for n in (1, 200):
        marks = ", ".join(f'@R(code = {i}, text = "x)")' for i in range(n))
        java = f"class A {{\n  @Responses({{{marks}}}) /** Late. */\n  int late() {{ return 1; }}\n  /** Early. */ @Responses({{{marks}}}) int early() {{ return 2; }}\n}}\n"
        assert [p.name for p in documented_functions(java, "java")] == ["early"]
        script = f"class A {{\n  @dec({{ a: [{marks.replace('@R', 'r').replace(' = ', ' + ')}] }}) /** Late. */\n  late() {{ }}\n  /** Early. */\n  early() {{ }}\n}}\n"
        assert [p.name for p in documented_functions(script, "typescript")] == ["early"]
