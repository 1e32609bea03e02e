"""Signatures and syntax queries."""

import time

import pytest

from quarry.operators import syntax

RUST = '''#[derive(Debug)]
pub struct Pair(i32, i32);
pub(crate) struct Named<T> where T: Copy {
    value: T, // }
}
/* outer /* inner } */ still */
enum Side { Left, Right }
trait Walk {
    fn declared(&self);
    fn given(&self) { let c = '}'; let s = r#"}"}"#; }
}
impl<'a> Walk for Pair {
    async unsafe fn go<'b>(x: &'b str) -> fn(i32) -> i32 {
        "}"
    }
}
impl Named<u8> {}
impl<T> Plain {}
macro_rules! make { () => { fn hidden() {} } }
'''
GO = '''package p

type (
	A struct {
		x int
	}
	B = int
	C []string
)
type Op func(int) (int, error)
func Run(a int) (b, c int) {
	f := func(x int) int { return x }
	s := `}`
	return f(a), 0
}
func (s *A) Get() int { return s.x }
func external(x int) int
func Map[K comparable](m K) { type local int }
'''
JS = '''const f = function inner() { return /[}]/.test("}") }
export default async function load(a, b = {x: 1}) {
  if (a) { b() }
  for (const x of a) { }
}
function* gen() {}
class Box extends Base {
  static async open({a}) { return `${a}}` }
  get size() { return 1 }
  #hidden() {}
  constructor() { super(); }
  field = () => { go() };
}
const api = { run(x) { return x }, async stop() {}, other: 1 }
const K = class Named { own() {} }
'''
TS = '''declare class Away { m(): void }
abstract class Half { abstract no(): void; yes<T>(x: T): {a: number} { return x } }
interface Shape { area(): number }
function over(a: string): void;
function over(a: any): void { }
'''
JAVA = '''package p;
@Deprecated
public final class Top<T> extends Base {
  int count = compute(1);
  private static final List<String> NAMES = of("}");
  public Top() { run(); }
  @Override
  @Named("a(b)")
  public List<T> all(int a) throws IOException { if (a > 0) { call(); } return null; }
  abstract int none();
  Runnable r = new Runnable() { public void run() { } };
  interface Inner { void ask(); }
  enum Side { LEFT, RIGHT; int weight() { return 1; } }
}
'''
C = '''#include <x.h>
#define BAD(x) { \\
  x
struct point { int x; };
static struct point *make(void) { return 0; }
static int sum(int a,
               int b)
{
  if (a) { return b; }
  return call(a);
}
int declared(int);
int table[] = { f(1) };
'''
CPP = '''namespace a { namespace b {
template <typename T, int N = (2 > 1)>
T first(T x) { return x; }
struct Base : public Other { void method() { } };
void Base::out() { }
} }
extern "C" { int plain() { return 0; } }
'''
BASH = '''#!/bin/bash
# not() { this
my-func() {
  echo "}" '}' ${x#y} \\}
  cat <<EOF
}
EOF
}
function other { case $x in a) echo ;; esac; }
function both() ( echo )
'''
HCL = '''# "x" {
resource "a" "b" {
  count = length(["}"])
  nested {
    k = { x = 1 }
  }
}
locals { a = 1 }
'''
WANT = {
    "rust": (RUST, [("struct", "Pair", 2, 2), ("struct", "Named", 3, 5), ("enum", "Side", 7, 7), ("trait", "Walk", 8, 11), ("function", "given", 10, 10), ("impl", "Pair", 12, 16), ("function", "go", 13, 15), ("impl", "Plain", 18, 18)]),
    "go": (GO, [("struct", "A", 3, 9), ("struct", "C", 3, 9), ("struct", "Op", 10, 10), ("function", "Run", 11, 15), ("method", "Get", 16, 16), ("function", "external", 17, 17), ("function", "Map", 18, 18)]),
    "javascript": (JS, [("function", "load", 2, 5), ("class", "Box", 7, 13), ("method", "open", 8, 8), ("method", "size", 9, 9), ("method", "constructor", 11, 11), ("method", "run", 14, 14), ("method", "stop", 14, 14), ("method", "own", 15, 15)]),
    "typescript": (TS, [("class", "Away", 1, 1), ("method", "yes", 2, 2), ("interface", "Shape", 3, 3), ("function", "over", 5, 5)]),
    "java": (JAVA, [("class", "Top", 2, 14), ("method", "all", 7, 9), ("method", "none", 10, 10), ("method", "run", 11, 11), ("interface", "Inner", 12, 12), ("method", "ask", 12, 12), ("method", "weight", 13, 13)]),
    "c": (C, [("struct", "point", 4, 4), ("struct", "point", 5, 5), ("function", "sum", 6, 11)]),
    "cpp": (CPP, [("function", "first", 3, 3), ("struct", "Base", 4, 4), ("function", "plain", 7, 7)]),
    "bash": (BASH, [("function", "my-func", 3, 8), ("function", "other", 9, 9), ("function", "both", 10, 10)]),
    "hcl": (HCL, [("struct", "resource", 2, 7), ("struct", "nested", 4, 6), ("struct", "locals", 8, 8)]),
    "python": ("@d\ndef f(\n  a):\n  class C:\n    async def g(self): pass\n", [("function", "f", 2, 5), ("class", "C", 4, 5), ("function", "g", 5, 5)]),
}


@pytest.mark.parametrize("language", list(WANT))
def test_declarations(language):
    text, want = WANT[language]
    assert [(x["kind"], x["name"], x["line_start"], x["line_end"]) for x in syntax.scan(text, language)["found"]] == want
    if language == "typescript":
        assert syntax.scan(text, "tsx") == syntax.scan(text, language)


SHAPES = {
    "two words": "foo bar\n", "modifiers": "static const int value1\n", "one word": "identifier\n", "blank": "\n", "unclosed": "fn f() {\n",
    "quotes": "'\"`", "comments": "/* ", "declarations": "fn a(b) { }\n", "heads": "impl<a class b interface c func type ", "slashes": "/ = [/[ ", "templates": "template <a b(c) { } ",
    "heredocs": "cat <<EOF\n", "raw strings": 'r#"', "methods": "class A { b(c) { } }\n",
}


def timed(text, language):
    began = time.process_time()
    syntax.scan(text, language)
    return time.process_time() - began


@pytest.fixture(scope="module")
def unit():
    """What a mebibyte of ordinary code takes on this machine, as it is just now."""
    return timed("fn one(a: i32) {\n    two(a + 1);\n}\n" * 30_000, "rust")


@pytest.mark.parametrize("shape", list(SHAPES))
def test_time_grows_with_the_text(shape, unit):
    """A mebibyte of each of the first five, a quarter of the others, in any language: about a second at most, and two are
    allowed, or twice what ordinary code takes where the machine is slow."""
    size = 1 << (20 if shape in list(SHAPES)[:5] else 18)
    text = (SHAPES[shape] * (size // len(SHAPES[shape]) + 1))[:size]
    for language in syntax.LANGUAGES:
        took = timed(text, language)
        assert took < max(2, 2 * unit), language


def test_the_end_of_a_file_ends_what_is_open():
    for language in syntax.LANGUAGES:
        for text in ("", "{", "}", "fn f(", "class A {", "func (", "type (", "struct", "impl", "/*", "'", '"', "`", "<<E", "f()", "@", "a.b(", "new A(", "pub(", "export"):
            assert syntax.scan(text, language)["found"] in ([], syntax.scan(text, language)["found"])


def asked(spark, text, query, path="a.rs", **more):
    from quarry.operators import corpus, nodes

    f = corpus.with_language(spark.createDataFrame([(path, text)], "relative_path string, content string"))
    return [(r.line_start, r.line_end, r.matched_code) for r in nodes.search_ast(f, path, query, **more).collect()]


SOURCE = '// first\nfn one(a: i32) { call(a); other("x"); }\nstruct S { x: i32 }\nimpl S {\n    fn two() { call(2); inner::call("y") }\n}\nfn three();\n'


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("(function_item name: (identifier) @name) @def", ["fn one(a: i32) { call(a); other(\"x\"); }", 'fn two() { call(2); inner::call("y") }']),
        ("(function_item name: (identifier) @name)", ["one", "two"]),
        ("; a comment\n(function_item (block (call_expression function: (identifier) @f arguments: (arguments (string_literal)))))", ["other", "call"]),
        ("(call_expression function: (_) @f (#eq? @f \"call\"))", ["call", "call", "call"]),
        ("((call_expression function: _ @f) (#not-eq? @f \"call\"))", ["other"]),
        ("(call_expression function: (identifier) @f (#has-ancestor? @f impl_item))", ["call", "call"]),
        ("(impl_item (_ (function_item body: (block) @b)))", ['{ call(2); inner::call("y") }']),
        ("[(struct_item) (impl_item)] @item", ["struct S { x: i32 }", 'impl S {\n    fn two() { call(2); inner::call("y") }\n}']),
        ("(line_comment) @c (impl_item type: (type_identifier) @t)", ["// first", "S"]),
        ("(function_item)", []),
        ("(call_expression (identifier) @a (arguments (identifier) @b)) (function_item !body) @none", ["call"]),
        ('(call_expression arguments: (arguments) @a (#match? @a "^.[0-9]"))', ["(2)"]),
        ('(block (call_expression (identifier) @a) (call_expression (identifier) @b) (#eq? @a @b))', ["call"]),
        ('((identifier) @x (#any-of? @x "three" "inner"))', ["inner", "three"]),
    ],
)
def test_syntax_queries(spark, query, want):
    assert [x[2] for x in asked(spark, SOURCE, query)] == want


def test_syntax_queries_of_other_languages(spark):
    python = "@wrap\ndef f(a, *b, c=1):\n    'é'; x = g(a)[0].h\n    if a: return not b\nclass C(D, metaclass=E):\n    async def m(self): pass\n"
    ask = lambda q: [x[2] for x in asked(spark, python, q, "a.py")]
    assert ask("(class_definition superclasses: (argument_list (identifier) @base))") == ["D"]
    assert ask("(function_definition name: (identifier) @n parameters: (parameters (identifier) @p))") == ["f", "f", "f", "m"]
    assert ask("(assignment left: (identifier) @l right: (attribute object: (subscript value: (call function: (identifier) @f)) attribute: (identifier) @a))") == ["x"]
    assert ask("(if_statement condition: (identifier) consequence: (block (return_statement (not_operator) @x)))") == ["not b"]
    assert ask("(decorated_definition (decorator (identifier) @d) definition: (function_definition))") == ["wrap"]
    assert ask("(string) @s") == ["'é'"] and ask("(keyword_argument name: (identifier) @k value: (identifier) @v)") == ["metaclass"]
    assert [x[:2] for x in asked(spark, python, "(class_definition body: (block) @b)", "a.py")] == [(6, 6)]
    assert asked(spark, GO, "(type_declaration (type_spec name: (type_identifier) @n))", "a.go") == [(4, 4, "A"), (8, 8, "C"), (10, 10, "Op")]
    assert [x[2] for x in asked(spark, C, "(function_definition declarator: (function_declarator declarator: (identifier) @n parameters: (parameter_list)) body: (compound_statement))", "a.c")] == ["sum"]
    assert [x[2] for x in asked(spark, JAVA, "(method_declaration name: (identifier) @n body: (block (_ (method_invocation name: (identifier)))))", "A.java")] == ["all"]
    assert [x[2] for x in asked(spark, HCL, '(block (identifier) @b (string_lit))', "a.tf")] == ["resource", "resource"]
    assert [x[2] for x in asked(spark, TS, "(interface_declaration name: (type_identifier) @n body: (interface_body))", "a.ts")] == ["Shape"]


@pytest.mark.parametrize("query", ["(not_a_real_node)", "(function_item nofield: (identifier))", "(function_item", ")", "", "  ; only\n", "(function_item)) @x", "(function_item)? @x", '"fn" @x', "(identifier) @a (#eq? @b \"x\")", "((identifier) @a (#unknown? @a \"x\"))", "((identifier) @a (#eq? @a))", "(identifier) @x " * 2000, "(_ " + "[(block) (group)] " * 9 + ") @x"])
def test_bad_syntax_queries(spark, query):
    with pytest.raises(ValueError, match="syntax query"):
        asked(spark, SOURCE, query)


def test_limits_of_syntax_queries(spark):
    many = "".join(f"fn f{k}() {{}}\n" for k in range(1200))
    assert len(asked(spark, many, "(function_item) @f")) == 1000 and asked(spark, many, "(function_item) @f", max_results=2)[1] == (2, 2, "fn f1() {}")
    with pytest.raises(Exception, match="a match is too large"):
        asked(spark, "fn f() { " + "x();" * 17_000 + "}", "(function_item) @f")
    with pytest.raises(Exception, match="the matches are too large"):
        asked(spark, ("fn f() { " + "x();" * 15_000 + "}\n") * 36, "(function_item) @f")
    with pytest.raises(Exception, match="does not parse"):
        asked(spark, "def f(:", "(identifier) @x", "a.py")
    for bad in ({"max_results": 0}, {"max_results": 1001}):
        with pytest.raises(ValueError):
            asked(spark, SOURCE, "(block) @b", **bad)
    with pytest.raises(ValueError, match="no syntax trees"):
        asked(spark, "x", "(identifier) @x", "a.rb")


def test_nodes_nest(spark):
    """Every node lies within its parent, in order; intervals are those of the descendants."""
    from quarry.functions import nodetree

    for language, (text, _) in WANT.items():
        found = nodetree.nodes(text, language)
        kinds, fields = nodetree.vocabulary(language)
        below = {n[0]: [] for n in found}
        for n in found:
            assert n[3] in kinds and n[4] in fields | {None}, (language, n)
            if n[2] is not None:
                p = found[n[2]]
                assert p[0] < n[0] <= p[1] and p[5] <= n[5] <= n[6] <= p[6], (language, n, p)
                below[n[2]].append(n)
            if n[9] is not None:
                assert text[n[5] : n[6]] == n[9]
        for n in found:
            assert n[1] == max([n[0], *(c[1] for c in below[n[0]])])


@pytest.mark.parametrize("language", ["rust", "go", "java", "c", "cpp", "javascript", "typescript", "bash"])
def test_lines_of_plain_calls_do_not_change_declarations(language):
    from quarry.functions.declarations import declarations
    from quarry.functions.tokens import Tokens

    def found(t):
        return [(t.line(t.at[a]), t.line(t.ends[z] - 1), kind, name) for a, z, kind, name, _ in declarations(t)]

    calls = "\n  x();\n  y(a, b.c);\n"
    heads = ["fn f() {", "func f() {", "function f() {", "int f(int a) {", "class A { void f() {", "fn // {", "struct S /* ; */", "type (\n A int;", "\"open {", "f() {"]
    for head in heads:
        for tail in ("}", "}\nfn g() {}", "x(struct foo);\n}", "struct T;\n}", ""):
            source = head + calls * 3 + tail
            assert found(Tokens(source, language, brief=True)) == found(Tokens(source, language)), source
    if language != "bash":
        assert len(Tokens("fn f() {" + "\n  x();" * 1000 + "\n}", language, brief=True).text) < 10


@pytest.mark.parametrize("language", ["rust", "go", "java", "c", "typescript", "bash", "python"])
def test_trees_side_by_side(language, monkeypatch):
    """Trees of many files as arrays are those of each file; a line of calls that stands often is read once."""
    from quarry.functions import nodetree
    from quarry.operators import nodes

    calls = "\n  x();\n y(a, 2.5); z();\n\n if(x);\r\n fn(a);"
    heads = ["", "fn f() {", "func f() {", "class A { void f() {", "struct S /* ; */", "type (\n A int;", "\"open {", "m! { // c\n;", "def f(:"]
    texts = [head + calls * 3 + tail for head in heads for tail in ("}", "}\nfn g() {" + calls + "}", "", "// end")]
    f = nodes.Forest(texts, language)
    want, base = [], 0
    for k, text in enumerate(texts):
        want += [(k, -1 if n[2] is None else n[2] + base, f.code(n[3]), f.code(n[4]), *n[5:9]) for n in nodes._parsed(text, language)]
        base = len(want)
    assert list(zip(*(v.tolist() for v in (f.of, f.parent, f.kind, f.field, f.start, f.end, f.line_start, f.line_end)), strict=True)) == want
    if language not in ("bash", "python"):
        left_out: list = []
        assert len(nodetree.nodes("f() {" + "\n  x();" * 1000 + "\n}", language, left_out)) < 20 and len(left_out) == 1


def test_matches_equal_a_plain_search(monkeypatch):
    """Each way to find a pattern, made in parts of a few rows too."""
    from quarry.operators import nodes

    texts = [SOURCE, "fn a() {\n  x();\n  y(z, w);\n  x();\n}\n", "fn b() { c(d(e(f(1, g)))); }", ""]
    f = nodes.Forest(texts, "rust")
    n = range(len(f.parent))

    def ancestors(v):
        while (v := int(f.parent[v])) >= 0:
            yield v

    def plain(p):
        found = [()]
        for i, s in enumerate(p.steps):
            fits = [v for v in n if s.kind in (None, kind[v]) and s.field in (None, field[v]) and not any(f.parent[c] == v and field[c] in s.without for c in n)]
            fits = [v for v in fits if all(any(kind[a] in values for a in ancestors(v)) for name, on, values in p.predicates if name == "#has-ancestor?" and p.place(on) == i)]
            found = [(*m, v) for m in found for v in fits if not i or f.parent[v] == m[s.parent] and all(v > m[k] for k in range(1, i) if p.steps[k].parent == s.parent)]
        return sorted(found)

    names = {v: k for k, v in f._codes.items()}
    kind, field = [names[int(x)] for x in f.kind], [names[int(x)] for x in f.field]
    for query in ("(_ (_) @a (_) @b)", "(block (call_expression function: (identifier) @a) (_))", "(function_item !body) @f", "((identifier) @x (#has-ancestor? @x call_expression impl_item))", "(_ (_ (_ !function) @a) (_))"):
        (p,) = nodes.parse(query, "rust")
        for rows in (1, 1 << 20):
            monkeypatch.setattr(nodes, "ROWS", rows)
            parts = list(f.found(p))
            assert sorted(tuple(m) for part in parts for m in part.tolist()) == plain(p) and (rows == 1 or len(parts) <= 1), query


def test_syntax_queries_of_a_corpus(spark):
    """No join: files of the same path stay apart, and a corpus is dealt over the cluster however few parts it comes in."""
    from quarry.operators import corpus, nodes

    rows = [(f"{k % 3}.rs", f"fn f{k}() {{\n  x();\n  y{k}(a);\n}}\n") for k in range(60)] + [("a.go", "x()"), ("none.rs", None)]
    files = corpus.with_language(spark.createDataFrame(rows, "relative_path string, content string").coalesce(1))
    got = nodes.search_corpus(files, '(call_expression function: (_) @f) @c ((function_item name: (_) @n) (#match? @n "5$"))', "rust")
    want = [(f"{k % 3}.rs", line, line, name) for k in range(60) for line, name in ((2, "x()"), (3, f"y{k}(a)"))] + [(f"{k % 3}.rs", 1, 1, f"f{k}") for k in range(60) if k % 10 == 5]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
