import ast
import itertools
import random
import sys
import time

import pytest

from tesserae.llm import syntax
from tesserae.llm.peg import END, Grammar

VALID = {
    "Python": ["", "x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    '''doc {'''\n    return [x for x in a if x]\n", "if a: b\nelif c:\n    d\nelse:\n    pass\n", "@d\nclass A(B):\n    x: int = 1\n", "try:\n    a()\nexcept (B, C) as e:\n    raise X from e\nfinally:\n    pass\n", "match x:\n    case [1, *r]:\n        pass\n", "a = {**b, 'c': 1}\nasync def f():\n    await g()\n", "x = (1 +\n  2)\n"],
    "JavaScript": ["const a = /[{(]x[^}]*/.exec(b);", "let a = 1\nlet b = a\nfoo(b)\n", "export default async function* f(a, {b, c: [d]}, ...e) { yield* g(); }", "class A extends B { static #x = 1; get y() { return this.#x; } async *z() {} }", "for (const [k, v] of m) { if (k) continue; else break }", "x = a ? b => ({...b, c: `t ${d}`}) : null;", "import a, { b as c } from 'd';", "switch (a) { case 1: b(); break; default: c() }"],
    "TypeScript": ["const a: Map<string, Array<number>> = new Map();", "interface A<T> extends B { x?: number; f(a: string): void; [k: string]: any }", "export type A = { [K in keyof T]: T[K] } | 'x'\n", "abstract class A { constructor(private readonly x: number) { super(); } abstract f(): void; }", "function f<T extends B>(this: C, x: T[]): x is D { return x as unknown as D; }", "enum E { A = 1, B }"],
    "Java": ["package a.b; import c.*; public class A<T extends B> implements C<T> { private final int[] x = {1, 2}; A(int y) throws E { this.x[0] = y; } @Override public <U> U f(List<? super U> u) { for (var v : u) { try (R r = g()) { return (U) v; } catch (X | Y e) { throw e; } } return switch (x) { case 1 -> a; default -> b; }; } }", "enum E { A(1) { }, B; int f() { return x.stream().map(String::valueOf).toList(); } }", "record P(int x) {}"],
    "Go": ["package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\nfunc (s *T[K]) f(a, b int, c ...string) (int, error) {\n\tfor i := range a {\n\t\tif x, ok := m[i]; ok && y {\n\t\t\tgo func() { z <- x }()\n\t\t}\n\t}\n\tv := map[string][]int{\"a\": {1}}\n\tswitch t := v.(type) {\n\tcase int:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\treturn a[1:], T{x: 1}\n}\n\ntype T[K any] struct {\n\ta, b int `json:\"a\"`\n\tE\n}\n"],
    "Rust": ["use a::{b, c::*};\n#[derive(Debug)]\npub struct S<'a, T: B + 'a> { pub x: &'a T }\nimpl<'a, T> S<'a, T> where T: B { pub fn f(&mut self, x: Vec<u8>) -> Option<T> { let y = |z| z + 1; match x { Some(v) if v > 1 => g(v), [a, ..] | _ => return None, } for i in 0..10 { s.h::<u8>(i)?; } if let Some(q) = w { q } else { r#\"x\"#; vec![1; 2] } } }", "fn main() { println!(\"{}\", 'a'); }"],
    "C": ["#include <x.h>\n#define A(x) \\\n  (x)\ntypedef struct s { int a : 3; char *b[4]; } s_t;\nstatic const unsigned char D[] = { 0x1, 'a', };\nint f(const s_t *p, int (*g)(void), ...) { for (int i = 0; i < 3; i++) { p->a += sizeof(int) * (unsigned) i; } do { x = y ? 1 : 2; } while (0); goto end; end: return 0; }"],
    "C++": ["namespace a::b { template <typename T, int N = 3> class C final : public D<T> { public: explicit C(int x) : y{x}, z(1) {} ~C() override = default; virtual int f() const noexcept = 0; bool operator==(const C& o) const; private: std::vector<std::pair<int, T>> y{}; }; }\nauto g = [&, x = 1](auto&& v) -> int { for (const auto& [k, w] : m) { v.push_back(static_cast<int>(k)); } return *p; };\nconst char *r = R\"x(}} )y\")x\";"],
}
INVALID = {
    "Python": ["def f(:\n", "x = = 1\n", "if a:\nb\n", "a b\n", "x = 'abc\n", "<<<<<<< HEAD\n", "  x = 1\n y = 2\n", "else:\n    pass\n", "int x = 1;\n"],
    "JavaScript": ["const a: number = 1;", "function f( {", "x = ;", "id,title,stored on,weight\n1,2,3 kg", "<<<<<<< ours\nx\n=======\n", "if (a) { b() ", "package a;\n"],
    "TypeScript": ["int f(int a) { return 1; }", "const a: = 1;", "let x = [1, 2;"],
    "Java": ["class A { void f( { } }", "int x = ;", "def f(a):\n    return a\n", "class A { int f() { return 1 } }"],
    "Go": ["package a\nfunc f() {\n", "package a\nx := \n", "class A {}\n", "package a\nfunc f() { if x { } else }\n"],
    "Rust": ["fn f( {", "let x = 1;", "fn f() { let = 1; }", "import a from 'b';"],
    "C": ["class A { public: int x; };", "int f( { return 0; }", "int x = 1", "/* open"],
    "C++": ["import { a } from 'b';", "class A { public int x; };", "int f() { return 1; "],
}


@pytest.mark.parametrize(("name", "text"), [(n, t) for n, ts in VALID.items() for t in ts])
def test_valid(name, text):
    assert syntax.diagnose(name, text) is None


@pytest.mark.parametrize(("name", "text"), [(n, t) for n, ts in INVALID.items() for t in ts])
def test_invalid(name, text):
    offset, cause = syntax.diagnose(name, text)
    assert 0 <= offset <= len(text) and cause


def test_python_agrees_with_its_own_parser_under_edits():
    random.seed(9)
    base = "".join(VALID["Python"][1:])
    for _ in range(400):
        at = random.randrange(len(base))
        text = base[:at] + random.choice(["", "(", ")", ":", " ", "\n", "=", "x", "'"]) + base[at + random.randint(0, 2) :]
        try:
            compile(text, "x", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
            good = True
        except SyntaxError as e:
            good = False
            if not any(k in e.msg for k in ("invalid syntax", "never closed", "unmatched", "expected", "indent", "unterminated")):
                continue  # what the language forbids beyond its grammar
        if good:
            assert syntax.language("Python").parses(text), text


def test_causes():
    assert syntax.diagnose("Go", "package a\nfunc f() {\n")[1] == "truncated"
    assert syntax.diagnose("C", "int x;\n<<<<<<< HEAD\nint y;\n") == (7, "merge_conflict")
    assert syntax.diagnose("C", "int x;\n<<<<<<< HEAD\nint y;\n=======\nint z;\n>>>>>>> other\n") == (7, "merge_conflict")
    deep = "namespace a {\nvoid f() {\n  g();\n<<<<<<< ours\n  h();\n=======\n  i();\n>>>>>>> theirs\n}\n}\n"
    assert syntax.diagnose("C++", deep) == (deep.index("<<<"), "merge_conflict")
    nested = "namespace a {\nvoid f() {\n  g();\n  if (x y) { z(); }\n}\n}\n"
    assert nested.count("\n", 0, syntax.diagnose("C++", nested)[0]) == 3
    assert syntax.diagnose("JavaScript", "let a = [1, 2);")[1] == "bracket"


def test_conflicts_outside_strings_only():
    titled = "\"\"\"\nTitle\n=======\n\"\"\"\ndef f(:\n    pass\n"
    assert syntax.diagnose("Python", titled)[1] != "merge_conflict" and titled.count("\n", 0, syntax.diagnose("Python", titled)[0]) == 4
    quoted = "x = '''\n<<<<<<< a\n=======\n>>>>>>> b\n'''\ny = = 1\n"
    assert syntax.diagnose("Python", quoted)[1] == "syntax"
    for name, mark in (("Python", "x = 1"), ("JavaScript", "let x = 1;")):
        text = f"{mark}\n<<<<<<< ours\n{mark}\n=======\n{mark}\n>>>>>>> theirs\n"
        assert syntax.diagnose(name, text) == (len(mark) + 1, "merge_conflict")


def _bad_line(text):
    found = syntax.diagnose("Python", text)
    return found and text.count("\n", 0, found[0]) + 1


def test_first_bad_line_of_blocks():
    assert _bad_line("if a:\n    b\nelif c:\n    d\n\nx = 1\ny = 2\n\nelse:\n    z\n") == 9
    assert _bad_line("try:\n    a\nexcept B:\n    c\nelse:\n    d\nfinally:\n    e\nexcept F:\n    g\n") == 9
    assert _bad_line("try:\n    a\nx = 1\n") == 3
    assert _bad_line("def f():\nx = 1\n") == 2 and _bad_line("x = 1\n  y = 2\n") == 2 and _bad_line("if a:\n    b\n  c\n") == 3
    assert _bad_line("@d\nx = 1\n") == 2 and _bad_line("match x:\n    y = 1\n") == 2 and _bad_line("for a in b:\n    c\nelse:\n    d\nelse:\n    e\n") == 5
    assert _bad_line("class A:\n    def f(self):\n") == 2
    deep = "if a:\n" + " " * 2000 + "b\n"
    assert _bad_line(deep) is None and _bad_line(deep + " " * 1500 + "c\n") == 3


def _ends(lines):
    """Lines that may close what is open after some lines."""
    depth = len(lines[-1]) - len(lines[-1].lstrip())
    closing = [[], [" " * (depth + 1) + "pass"], [" " * (depth + 1) + "case 1: pass"], [" " * depth + "def g(): pass"]]
    tries = [" " * d + "finally: pass" for d in range(depth, -1, -1)]
    return closing + [[*first, *some] for first in closing for n in range(1, 4) for some in itertools.combinations(tries, n)]


def test_blocks_read_line_by_line_agree_with_the_grammar():
    rng = random.Random(13)
    kinds = ["x = 1", "if a:", "elif b:", "else:", "try:", "except E:", "finally:", "for a in b:", "with a:", "def f():", "@d", "pass", "if a: b", "while c: pass", "match x:", "case 1:", "else: z", "case 2: y"]
    own = syntax.language("Python")
    for _ in range(4000):
        depth, lines = 0, []
        for _ in range(rng.randint(1, 7)):
            lines.append(" " * depth + rng.choice(kinds))
            depth = max(0, depth + (rng.random() < 0.9 if lines[-1].endswith(":") else -(rng.random() < 0.4) * rng.randint(1, 2)))
        text = "\n".join(lines) + "\n"
        s = own.grammar.reduce(own.symbols(own.prepared(text)))
        bad = syntax.blocks().first_bad(own.grammar, syntax.blocks().lines(s))
        assert own.parses(text) == (bad is None), text
        if bad:  # what stands before the first bad line can go on in some way
            assert any(own.parses("\n".join([*lines[:bad], *end]) + "\n") for end in _ends(lines[:bad])), text


def test_long_files_report_in_linear_time():
    text = "".join(f"def f{i}(a):\n    if a:\n        return {i}\n    return a\n\n" for i in range(6000)) + "else:\n    x\n"
    syntax.diagnose("Python", "x = = 1\n")
    began = time.process_time()
    assert _bad_line(text) == 30_001
    assert time.process_time() - began < 3


def test_case_patterns():
    good = ["case 1:", "case -1 + 2j:", "case 'a' 'b' | None:", "case [1, *rest]:", "case (a, b) if a > b:", "case Point(x=1, y=[_, 2]) as p:", "case {'a': 1, **rest}:", "case a.b.C():", "case *a, b:", "case ():", "case (1 | 2):", "case x,:"]
    bad = ["case 1 2 3:", "case Point(x=1 y=):", "case [1 2]:", "case {'a'}:", "case a b:", "case (*a):", "case 1 +:", "case x as:", "case f(x)(y):"]
    whole = "match x:\n    {}\n        pass\n"
    assert all(syntax.language("Python").parses(whole.format(c)) for c in good)
    assert not any(syntax.language("Python").parses(whole.format(c)) for c in bad)


def test_packrat_is_linear_in_nesting():
    grammar = Grammar("Program <- Sum\nSum <- One ('+' Sum)?\nOne <- '-' One / NUM / P.Program", "", "+ -")
    assert grammar.full("Program", grammar.reduce("(" * 200 + "0" + ")" * 200))
    assert not grammar.full("Program", grammar.symbols["-"] * 2000)


def test_judging_takes_few_calls_a_symbol():
    for name, texts in VALID.items():
        syntax.language.cache_clear()
        own, calls = syntax.language(name), []
        size = sum(len(own.symbols(own.prepared(text))) for text in texts)
        sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)  # noqa: B023
        try:
            for text in texts:
                own.parses(text)
        finally:
            sys.setprofile(None)
        assert len(calls) < 25 * size, (name, len(calls) / size)


def test_generated_matchers_agree_with_the_closures():
    rng = random.Random(7)
    for name, texts in VALID.items():
        own = syntax.language(name)
        grammar = own.grammar
        for text in texts + INVALID[name]:
            own.parses(text)
        pieces = sorted({s for _, s in grammar.memo if s})
        signs, met = sorted({c for s in pieces for c in s}), 0
        for _ in range(300):
            s = list(rng.choice(pieces)[:60])
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randint(0, 1)] = rng.choices(signs, k=rng.randint(0, 1))
            s = "".join(s)
            for rule in rng.sample(sorted(grammar.numbers.values()), 8):
                end = grammar.compiled[rule](s, 0, {})
                assert grammar.matchers.rules[rule](s + END, 0, {}) == end, (name, rule, s)
                met += end > 0
        assert met > 100


def test_rows(spark):
    rows = [(1, "r", "a.py", "x = (", "z"), (1, "r", "a.py", "x = (", "z"), (2, "r", "b.js", "", "z"), (3, "r", "c.go", None, "z"), (4, "r", "d.txt", "(", "z"), (5, None, None, "(", "z"), (6, "s", "E.PY", "x = 1\n" * 20_000, "z")]
    files = spark.createDataFrame(rows, "file_id bigint, repo_name string, path string, content string, language string")
    assert [r.file_id for r in syntax.invalid_files(files).collect()] == [1]
    assert [(r.file_id, r.line, r.cause) for r in syntax.failures(files).collect()] == [(1, 1, "truncated")]
    parsed = spark.createDataFrame([(1, True, None)], "file_id bigint, success boolean, parsed_at timestamp")
    assert {(r.repo_name, r.language, r.n_files, r.n_invalid, r.n_recorded_wrong) for r in syntax.rates(files, parsed).collect()} == {("r", "Python", 1, 1, 1), ("r", "JavaScript", 1, 0, 0), ("r", "Go", 1, 0, 0), ("s", "Python", 1, 0, 0)}
    assert syntax.invalid_files(files.limit(0)).count() == 0
