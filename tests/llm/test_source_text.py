import ast
import datetime as dt
import warnings

import pytest

from graphlode.llm import docpairs, grammars, origin, pieces, validity
from graphlode.sources import lexing

GOOD = {
    "python": ["def f(a, /, b: int = 1, *c, d, **e) -> int:\n    return a if b else lambda x, *y: x\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': y, **z} | C(q=1) as w:\n        pass\n", "async def g():\n    async with a as b, c: yield\n    [x async for x in y if z]\n", "x: list[int] = [i for i in range(3)]; y = (yield)\n" if False else "type A[T] = list[T]\nclass B[T](C, metaclass=D):\n  '''d'''\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nfinally:\n  del a[1:2, ...]\n", "with (open(a) as b, c as d):\n\tpass\n", "f'{a!r:>{w}}' rb'x'\nx = 1_000 + 0x_ff + 1e-3j\n", "@a.b(c)\n# note\n\n@d\nclass E: x = 1; y = 2\n", "print(*a, **b, c=1, d=(e := 2))\n", "if a:\n    b\n  # odd comment\nelif c: d\nelse:\n    e\n", "x = [\n 1,\n# c\n 2]\n\\\n\n"[:-4]],
    "javascript": ["export default async function* f(a,{b=1,...c},[d,,e]){ for await (const x of y) yield* x; }", "class A extends (B, C) { #x = 1; static { this.y = 2 } get a(){return this.#x} static async *g(){} ['k']=3; x }", "let y = a ?.b?.[c]?.(d) ?? e\n;[1,2].map(n=>n)", "var re = /[/]\\/(?<n>x)/giu, t = `a${`b${c}`}d`; if (a) b; else c", "label: for(;;){ break label }\ndo x++\nwhile(x<5)", "export { x as default, y }; import d, * as ns from 'x'"],
    "typescript": ["abstract class A<T extends object = {}> extends B<T> implements C { constructor(private readonly x: number, y?: string) { super() } abstract foo(): void; [k: string]: any }", "type X<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] }; enum E { A = 1 }", "function f(a: string): string\nfunction f(a: any): any { return <any>a as X satisfies Y }", "import type { A } from './a'; declare module 'x' { export const y: string }", "@Comp({a: 1}) export class Q { @Input() name!: string }"],
    "go": ["package a\nimport (\n\tf \"fmt\"\n)\ntype T[K comparable] struct { a, b int `x`; *E }\nfunc (t *T[K]) M(x ...int) (a int, err error) { defer func() { }(); return }\n", "package b\nfunc f() { for i := range 10 { _ = i }; switch x := y.(type) { case int: default: }; select { case c <- 1: } }\n"],
    "java": ["package a; sealed interface S permits A {} record P<T>(int x) { P { } } enum E { A(1) { }, B; E(int... a) { } }", "class X { int r = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; String s = \"\"\"\n hi\n \"\"\"; <T> void f() { if (o instanceof String t && t.isEmpty()) return; var g = X::new; int y = (int) z >>> 1; } }"],
    "rust": ["pub async fn f<'a, T: ?Sized + 'a, const N: usize>(mut x: &'a mut T) -> impl Fn(u32) -> bool + '_ where T: Clone { let Some(y) = z else { return }; match v { 1 | 2 => {} 3..=5 if q => w(), _ => {} } }", "fn g() { let c = move |a: u8| -> u8 { a }; println!(\"{}\", r#\"a\"b\"#); let t = S { a: 1, ..d }; 'l: loop { break 'l } }"],
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = = 3\n", "if a\n  b\n", "def f():\npass\n", "print 'x'\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n", "  x = 1\n", "x = 'abc\n", "class A\n  pass\n", "try:\n  a\nb\n", "x = 3 +* 4\n", "if a:\n    b\n   c\n"],
    "javascript": ["let x: number = 1", "function f( {", "a b", "if x { }", "for (let i = 0; i < 3; i++ { }", "x = 3 +* 4", "foo(1 2)", "interface A {}", "x = {a: 1 b: 2}", "const s = 'a", "`open", "/* open"],
    "typescript": ["let x: = 1", "class A { foo( }", "interface A { a: string b: number }", "fucntion f() {}", "... rest of the file unchanged ..."],
    "go": ["package a\nfunc f() { x = = 1 }", "func f() {}", "package a\nfunc f() int\n{\n}\n", "package a\nfun f() {}", "package a\nimport x\n"],
    "java": ["class A { int x = 1 }", "class A { void f() { x } }", "clas A {}", "class A { void f() { if x { } } }", "class A { char c = 'ab'; }"],
    "rust": ["fn f() { let x = 1 let y = 2; }", "fnn f() {}", "struct A { a u8 }", "let x = 1;", "fn f() { a b }"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_grammars(language):
    for text in GOOD[language]:
        assert grammars.valid(text, language), text
        assert grammars.valid(text.replace("\n", "\r\n"), language), text
    for text in BAD[language]:
        assert not grammars.valid(text, language), text


def test_python_grammar_agrees_with_the_parser():
    texts = GOOD["python"] + BAD["python"]
    cut = [t[:k] for t in GOOD["python"] for k in range(0, len(t), 3)]
    for text in texts + cut:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
                want = True
            except SyntaxError:
                want = False
        if want:
            assert grammars.valid(text, "python"), text
    for text in BAD["python"]:
        assert not grammars.valid(text, "python")


def test_ambiguity_costs_no_repeated_work():
    import time

    t = time.time()
    assert grammars.valid("x = " + "(" * 300 + "1" + ")" * 300 + "\n", "python")
    assert grammars.valid("x = " + " + ".join(["a<b>(c)"] * 2000) + ";", "typescript")
    assert grammars.valid("x = [" + "1, " * 20_000 + "]\n", "python")
    assert time.time() - t < 20


def test_files_and_rates(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [
        ("p", "a.py", "a.py", "x = (", True, t(1)), ("p", "a.py", "a.py", "x = 1\n", True, t(2)), ("p", "b.py", "b.py", "x = 1", True, t(1)), ("p", "b.py", "b.py", "x = (", True, t(2)), ("p", "b.py", "b.py", "x = (", True, t(2)), ("p", "c.py", "c.py", "  ", True, t(1)),
        ("p", "d.py", "d.py", None, True, t(1)), ("p", "e.py", "e.py:f", "x = (", True, t(1)), ("p", "f.py", "f.py", "x = (", False, t(1)), ("p", "g.txt", "g.txt", "x = (", True, t(1)), ("q", "h.ts", "h.ts", "let x = ;", True, None), (None, None, None, None, None, None),
        ("q", "long.js", "long.js", "f(" + "'a', " * 30_000 + "1);", True, t(1)), ("q", "deep.js", "deep.js", "x = " + "`${" * 3000, True, t(1)),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "project string, file_path string, qualified_name string, source_code string, found boolean, retrieved_at timestamp, valid int")
    assert {tuple(r) for r in validity.invalid(df).collect()} == {("p", "b.py"), ("q", "h.ts"), ("q", "deep.js")}
    got = {(r["project"], r["language"]): (r["files"], r["invalid"], r["rate"]) for r in validity.rates(df).collect()}
    assert got == {("p", "python"): (2, 1, 0.5), ("q", "typescript"): (1, 1, 1.0), ("q", "javascript"): (2, 1, 0.5)}
    assert validity.invalid(df.limit(0)).count() == 0


# -- pieces ----------------------------------------------------------------------------------------------------
def test_definition_lines():
    py = 'import a\n\ndef one():\n    """\ndef no():\n"""\n\n# about two\n@deco(\n    1)\nclass Two:\n    def m(self): pass\n\n# apart\n\nasync def three(): pass\nx = 1\n'
    assert pieces.definition_lines(py, "python") == [8, 16]
    go = "package a\n\n// A does.\nfunc A() {}\n\n/*\nfunc no() {\n*/\n\n// B does.\n//go:noinline\nfunc (t *T) B() {\n}\ntype C struct {\n}\nvar x = `\nfunc q() {\n`\n"
    assert pieces.definition_lines(go, "go") == [10, 14]
    rs = "struct A;\n\n/// d\n#[derive(X)]\npub(crate) struct B {\n}\nimpl B {\n    fn m() {}\n}\n\n#[doc = \"x\"]\nfn f<'a>() { let c = '{'; }\nconst U: &str = r#\"\nfn no() {\n\"#;\n"
    assert pieces.definition_lines(rs, "rust") == [3, 7, 11]
    ts = "const a = 1;\nexport class A {\n  m() {}\n}\n/** d */\nexport async function f() {\n  return `\nfunction no() {\n`;\n}\nexport default class B {}\n"
    assert pieces.definition_lines(ts, "typescript") == [5, 11]
    java = "package a;\n/** d */\n@Ann\npublic final class A {\n  void m() {}\n}\n@B(x = 1)\nclass C {\n}\n"
    assert pieces.definition_lines(java, "java") == [7]
    assert pieces.definition_lines("", "python") == [] and pieces.definition_lines("def a(): pass", "python") == []


def check_pieces(text, language, limit, overlap):
    found = pieces.split(text, language, limit, overlap)
    lines = [i for i, c in enumerate(text) if c == "\n"]
    at = 0
    for n, (a, z, first, last) in enumerate(found):
        assert 0 < z - a <= limit and first == sum(i < a for i in lines) + 1 and last == sum(i < z - 1 for i in lines) + 1
        assert a <= at < z
        if n and at - a:
            shared = text[a:at]
            assert shared.count("\n") <= overlap + 1
        at = z
    assert at == len(text)
    return found


@pytest.mark.parametrize("limit", [40, 300, 3000])
def test_pieces_cover_the_text_within_the_limit(limit):
    block = "def f{0}(a):\n    b = a + {0}\n    return b\n\n"
    for text in ("".join(block.format(i) for i in range(200)), "x" * 5000, "word " * 3000, "a\n" * 4000, "\n" * 100, "é日本\r\n" * 900, "y"):
        check_pieces(text, "python", limit, 2)
    found = check_pieces("".join(block.format(i) for i in range(200)), "python", 3000, 2)
    text = "".join(block.format(i) for i in range(200))
    cuts = [z for _, z, _, _ in found[:-1]]
    assert all(text.startswith("def ", c) for c in cuts)
    assert all(text[a:p].count("\n") == 2 for (a, _, _, _), p in zip(found[1:], cuts))


def test_piece_rows(spark):
    long = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(300))
    rows = [(1, "a.py", long, 11), (1, "a.py", long, 11), (2, "b.unknown", long, None), (3, "c.py", None, 1), (4, "d.py", "", 1), (5, None, "short", 7)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "id long, path string, code string, line int, text string")
    got = pieces.pieces(df, "id", "path", "code", "line").collect()
    assert {r["item_key"] for r in got} == {"1", "2", "5"} and min(r["first_line"] for r in got if r["item_key"] == "1") == 11
    assert [r["text"] for r in got if r["item_key"] == "5"] == ["short"]
    lines = sorted({r["line_no"] for r in pieces.places(df, "id", "path", "code", "line").collect()})
    assert lines == [11 + 3 * i for i in range(1, 300)]
    assert pieces.pieces(df.limit(0), "id", "path", "code").count() == 0


# -- documentation ---------------------------------------------------------------------------------------------
CODE = {
    "python": ('class A:\n    """class doc"""\n    @x\n    def m(self, a):\n        """Waits until the lock is free."""\n        s = "def no(): pass"\n        def inner(): pass\n\nasync def f(a,\n      b=")"):\n    # comment\n    \'\'\'Never blocks.\n\n    Args:\n      a: x\n    \'\'\'\n', {"A.m": "Waits until the lock is free.", "f": "Never blocks."}),
    "typescript": ("/** Wrong place. */\nconst a = 1;\n/**\n * Wins by age.\n * @param x the one\n */\nexport async function f(x: Map<string, number>): Promise<void> {\n  const s = `}${ {a: '}'} }`; // }\n  if (a) { g(/[}]/g); }\n}\nclass B<T> {\n  /** Drops the oldest. */\n  @d() private async m<T>(a = {}): Promise<T> { return { a } }\n  n() {}\n}\n", {"f": "Wins by age.", "B.m": "Drops the oldest.", "B.n": None}),
    "go": ("package a\n\n// F: Ties go left.\n//go:noinline\nfunc F(a func(int) int) (int, error) {\n\ts := `}`\n\treturn '}', nil\n}\n\n// detached\n\nfunc (t *T) M() {}\n", {"F": "Ties go left.", "T.M": None}),
    "rust": ("struct S;\nimpl<T> Tr for S {\n    /// Keeps both.\n    #[inline]\n    pub fn m<'a>(&'a self) -> char { '}' }\n}\n#[doc = \"Ends early.\"]\nfn f() { let r = r#\"}\"#; }\n// plain\nfn g() {}\n", {"S.m": "Keeps both.", "f": "Ends early.", "g": None}),
    "java": ("class A {\n  /** Waits twice. */\n  @Ann(\"x\") public <T> Map<String, T> m(List<T> a) throws E { char c = '}'; return x; }\n  int n() { if (a) { b(); } return 1; }\n}\n", {"A.m": "Waits twice.", "A.n": None}),
}


@pytest.mark.parametrize("language", sorted(CODE))
def test_captures(language):
    text, want = CODE[language]
    for source in (text, text.replace("\n", "\r\n")):
        got = {name: docpairs.useful(doc, name.rpartition(".")[2], params) for name, doc, params, _ in docpairs.extract(source, language)}
        for name, doc in want.items():
            assert name in got and (got[name] or "").split("\n")[0] == (doc or ""), (name, got)


def test_long_unclosed_texts_are_read_once():
    import time

    t = time.time()
    for language, text in (("javascript", "/** Waits. */\nfunction f(a) { return a }\n" + "{ (a, " * 60_000), ("java", "class A { /** Waits. */ void f() { } " + "void g(int a) { if (x) { " * 30_000), ("rust", "/// Waits.\nfn f() {}\n" + "fn g() { [( " * 30_000)):
        got = {n: d for n, d, _, _ in docpairs.extract(text, language)}
        assert got[next(n for n in got if n.rpartition(".")[2] == "f")] == "Waits."
    assert time.time() - t < 30


UNCLOSED = {
    "typescript": ("function open() { if (a) {\n/** Waits. */\nfunction f(a) { return a }\nclass B {\n  /** Keeps. */\n  m(a) { return { a } }\n  n() { if (a) { if (b) {\n  /** Drops. */\n  o() { }\n/** Ends. */\nfunction g() { }\n", {"f": "Waits.", "B.m": "Keeps.", "B.o": "Drops.", "g": "Ends."}),
    "go": ("package a\nfunc open() { if a {\n// f waits.\n//go:noinline\nfunc f() {}\n// M keeps.\nfunc (t *T) M() {}\n", {"f": "waits.", "T.M": "keeps."}),
    "rust": ("fn open() { if a {\n#[doc = \"Waits.\"]\nfn f() {}\nimpl T for S {\n    /// Keeps.\n    #[inline]\n    fn m() {}\n    fn n() { if a { if b {\n    /// Drops.\n    fn o() {}\n/// Ends.\nfn g() {}\n", {"f": "Waits.", "S.m": "Keeps.", "S.o": "Drops.", "g": "Ends."}),
    "java": ("class B {\n  /** Keeps. */\n  @Ann(\"x\") void m(int a) { b(); }\n  void n() { if (a) { if (b) {\n  /** Drops. */\n  int o() { return 1; }\n", {"B.m": "Keeps.", "B.o": "Drops."}),
}


@pytest.mark.parametrize("language", sorted(UNCLOSED))
def test_unclosed_texts_give_the_same_at_every_length(language):
    text, want = UNCLOSED[language]
    short = list(docpairs.extract(text, language))
    assert {name: docpairs.useful(doc, name, "") for name, doc, _, _ in short} == want
    assert list(docpairs.extract(text + "// x\n\n;" * 4000, language)) == short


@pytest.mark.parametrize("text", ["", " \n", "TODO", "TODO: document", "FIXME write docs", "n/a", "...", "-----", "sealPath", "seal_path()", "Seals the path.", "Function to seal the path", "seal path", "Auto-generated method stub", "{@inheritDoc}", "@param\n@returns", "eslint-disable-next-line", "a, b", "description", "No description provided."])
def test_trivial_descriptions(text):
    assert docpairs.useful(text, "sealPath", "(a, b)") is None


@pytest.mark.parametrize("text", ["Oldest path wins.", "Wraps at 9.", "件を超えたら古い順に捨てる", "Seals the path unless it is open."])
def test_useful_descriptions(text):
    assert docpairs.useful(text, "sealPath", "(a, b)") == text


def test_pairs(spark):
    rows = [
        ("p", "a.py:f", "Function", "a.py", None, "def f():\n    pass\n"), ("p", "a.py:f", "Function", "a.py", "Never blocks.", None), ("p", "a.py:g", "Function", "a.py", "Never blocks.", " "), ("p", "b.py", "Module", "b.py", None, CODE["python"][0]), ("p", "b.py", "Module", "b.py", None, CODE["python"][0]),
        ("p", "c.py:C.m", "Method", "c.py", None, "    def m(self):\n        '''Waits.'''\n"), ("p", "d.go:T.M", "Method", "d.go", "n/a", "// M runs it once.\nfunc (t *T) M() {}\n"), ("p", None, "Function", "x.py", "Doc it.", "x"), (None, "q.py:z", "Function", None, "Says why.", "def z(): pass"), ("p", "e.unknown:f", "Function", "e.unknown", "Says why.", "whatever"),
        ("p", "l.js", "Module", "l.js", None, "/** Long one. */\nfunction l() { return '" + "x" * 200_000 + "' }"), ("p", "u.js", "Module", "u.js", None, "function u() { " + "{" * 500),
    ]
    df = spark.createDataFrame([(*r, "d") for r in rows], "project string, qualified_name string, type string, file_path string, docstring string, source_code string, description string")
    got = {(r["project"], r["qualified_name"]): r["description"] for r in docpairs.pairs(df).collect()}
    assert set(got) == {("p", "a.py:f"), ("p", "b.py:A.m"), ("p", "b.py:f"), ("p", "c.py:C.m"), ("p", "d.go:T.M"), (None, "q.py:z"), ("p", "e.unknown:f"), ("p", "l.js:l")}
    assert got["p", "a.py:f"] == "Never blocks." and docpairs.pairs(df.limit(0)).count() == 0


# -- origin ----------------------------------------------------------------------------------------------------
HAND = "\n".join(f"def step_{w}(row):\n    '''Keeps {w}.'''\n    value = row.{w} + {i}\n    if value > {i}:\n        return value\n    return None\n" for i, w in enumerate("abcdefghij"))


def hand(k):
    """Source of its own structure for each k: the k-th function has k more lines."""
    text = HAND.replace("step", f"step{chr(97 + k)}").replace("row", f"row_{chr(97 + k)}").replace("value", f"value_{chr(97 + k)}")
    more = "".join(f"    if value_{chr(97 + k)} == {j}:\n        return [{', '.join(str(x) for x in range(j % 5))}]\n" + "    call(x" + ".y" * (k * 7 % 11) + ")\n" * (k >> j & 1) for j in range(5))
    return text.replace("    return None\n", more + "    return None\n")


def renamed(text):
    return text.replace("value_j", "amount").replace("row_j", "entry").replace("stepj_", "move_")


def test_origin(spark):
    t, old = dt.datetime(2025, 1, 2), dt.datetime(2025, 1, 1)
    cases = {
        "src/a.py": (hand(0), ""), "src/gen_tools/b.py": ("# Generates the report. Written by hand.\n" + hand(1), ""), "lib/vendor_portal/c.py": ("# Replaces the generated client, which we no longer use\n" + hand(2), ""),
        "src/d.py": ("# Code generated by x v1. DO NOT EDIT.\n" + hand(3), "generated"), "src/e.py": ("# Diese Datei wurde automatisch erzeugt (x). Nicht bearbeiten!\n" + hand(4), "generated"), "src/f_pb2.py": (hand(5), "generated"), "vendor/lib/g.py": (hand(6), "vendored"),
        "src/h.py": ('"""Copied verbatim from the x project, release 1.2"""\n' + hand(7), "vendored"), "src/i.js": ("!function(a){a.b=1,a.c='d'}(e);" * 30, "minified"), "src/j.py": ("TABLE = [" + "1.5, -2.25, " * 200 + "]\n", "data"), "src/k.ts": ('const BLOB = "' + "aZ09" * 300 + '";\n', "data"),
        "src/l.py": ("def get_field_0001_x(m):\n    return m[1]\n", "generated"), "src/m.py": ("def f():\n    '''Auto-generated method stub'''\n    return g(1)\n", ""), "src/n.py": (None, ""), "node_modules/x/o.js": (None, "vendored"), "src/p.py": (" \n", ""), "src/q.py": (hand(11) + "\n# source: a.yaml -- edits here get overwritten\n", "generated"),
        "src/t.go": ("package data\n\nvar t = []any{\n" + "  []any{\"ab\", 12, \"cd\"},\n" * 60 + "}\n", "data"), "src/u.py": ('"""imported snapshot of x (rev 1a), do not reformat"""\n' + hand(14), "vendored"),
        "tests/test_issues.py": ("def test_issue_12345():\n    assert fix(1) == 2\n" + hand(15), ""), "src/steps.py": ("# Do not change the order of these steps\n" + hand(16), ""), "src/care.py": ("# Built with care by the core team\n" + hand(17), ""),
        "src/deps/graph.py": (hand(18), ""), "deps/lib/graph.py": (hand(19), "vendored"), "src/emit.py": ("# Emits stubs; the files it writes carry a do-not-edit banner\n" + hand(20), ""), "src/free.py": ("# Helper for the x code generator, edit freely\n" + hand(21), ""),
        "src/r.py": (hand(12) + '\n"""Vendored from x 1.2; local patches: none"""\n', "vendored"), "src/s.py": (hand(13) + "\nX = '# Code generated by x. DO NOT EDIT.'\n", ""),
    }
    rows = [(f, "p", f, f, s, t) for f, (s, _) in cases.items()] + [("src/a.py", "p", "src/a.py", "src/a.py", "# @generated\n", old), ("src/m.py:f", "p", "src/m.py", "src/m.py:f", "/** Auto-generated method stub */\nfunction f() {}", t)]
    rows += [(f"copy{i}", f"q{i}", f"lib/copy{i}.py", f"lib/copy{i}.py", hand(9) if i % 2 else renamed(hand(9)), t) for i in range(4)] + [("two0", "q0", "lib/two.py", "lib/two.py", hand(10), t), ("two1", "q1", "lib/two.py", "lib/two.py", hand(10), t)]
    rows += rows[:2] + [(None, "p", "x.py", "x.py", "# @generated", t), ("nopath", "p", None, None, "# @generated", t)]
    df = spark.createDataFrame([(*r, True) for r in rows], "id string, project string, file_path string, qualified_name string, source_code string, indexed_at timestamp, generated boolean")
    got = {(r["project"], r["file_path"]): {c for c in ("generated", "minified", "vendored", "data") if r[c]} for r in origin.judged(df).collect()}
    for f, (_, want) in cases.items():
        assert got["p", f] == ({want} if want else set()), (f, got["p", f])
    assert all(got[f"q{i}", f"lib/copy{i}.py"] == {"vendored"} for i in range(4)) and got["q0", "lib/two.py"] == set()
    assert len(got) == len(cases) + 6 and origin.foreign(df.limit(0)).count() == 0


def test_tokens_are_robust():
    for text in ("", "'", '"""', "`${", "/*", "r#\"", "'a", "\\", "\x00", "é" * 10, "a" * 100_000):
        for language in lexing.EXTENSIONS.values():
            assert all(a < b for _, a, b in lexing.tokens(text, language))
