import time

import pytest
from pyspark.sql import functions as F

from graphloom.llm.documented import documented_pairs, learned_echoes
from graphloom.llm.islands import GO, JAVA, JAVASCRIPT, RUST, newlines, scan
from graphloom.llm.triviality import is_trivial


def names(text, grammar):
    return [(d.name, d.receiver) for d in scan(text, grammar)]


def test_go_heads_are_balanced():
    """Braces and brackets of result and parameter types are no bodies; nesting has no bound."""
    cases = {
        "func A() interface{} { return 1 }": "A", "func B() map[string]interface{} {\n\treturn nil\n}": "B", "func (s *Store[K,V]) M() struct{ X int } { return x }": "M",
        "func F[T ~[]int](x T) {}": "F", "func G(f func(g func(h func(i int) int) int) int) (a int, b func() error) { if x { } }": "G", "func H() <-chan struct{} { }": "H", "func I() func(int) (string, error) { return nil }": "I",
    }
    for text, name in cases.items():
        got = scan(text, GO)
        assert [(d.name, d.code) for d in got] == [(name, text)]
        got = scan("package p\n\n" + text + "\n\nfunc Last() {}\n", GO)
        assert [(d.name, d.code) for d in got] == [(name, text), ("Last", "func Last() {}")]
    deep = "func D(" + "a func(" * 200 + ")" * 200 + ") {}"
    assert scan(deep, GO)[0].code == deep


def test_members_of_types():
    java = "class A<T> {\n  private int x = foo(1);\n  A(int x) { this.x = x; }\n  /** Adds. */\n  @Foo(a = {1}, b = \"}\")\n  int add(int a, Map<String, List<X>> b) throws E { return a; }\n  abstract void m(int q);\n  enum E { P(1), Q(2) { void z() {} }; E(int i) {} }\n  interface I { int size(); default void x() { foo(); } }\n  void last() { if (a) { b(); } }\n}"
    assert names(java, JAVA) == [("A", "A"), ("add", "A"), ("m", "A"), ("E", "E"), ("size", "I"), ("x", "I"), ("last", "A")]
    assert scan(java, JAVA)[1].comment == "/** Adds. */" and scan(java, JAVA)[1].code.endswith("{ return a; }")
    js = "// Inits.\nclass Foo extends Bar {\n  constructor(a, {b} = {}) { super(a); }\n  static async *gen(x) { yield x; }\n  handle = async (e) => { this.x(e); }\n  x = 1\n  next() { return /}/.test(`}`); }\n}\n// Arrow.\nconst add = (a, b) => a + b;\nexport const f = async function (q) { return q }\nfunction outer() { function inner() { return 1 } return inner }\ninterface Z { foo(x: number): string\n bar?(): { a: number }; }\nfunction t(x: T): { a: number } { return x }\nconst z = call(1);"
    assert names(js, JAVASCRIPT) == [("constructor", "Foo"), ("gen", "Foo"), ("handle", "Foo"), ("next", "Foo"), ("add", ""), ("f", ""), ("outer", ""), ("inner", ""), ("foo", "Z"), ("bar", "Z"), ("t", "")]
    found = {d.name: d for d in scan(js, JAVASCRIPT)}
    assert found["add"].comment == "// Arrow." and found["add"].code == "const add = (a, b) => a + b" and found["t"].code.endswith("{ return x }")
    rust = "trait T { fn a(&self) -> u8; fn b(&self) { } }\nmod m { impl X { pub(crate) fn deep<F: Fn(i32) -> i32>(f: F, x: [u8; { 3 }]) -> R where F: S { let c = '{'; } } }"
    assert [d.name for d in scan(rust, RUST)] == ["a", "b", "deep"] and scan(rust, RUST)[2].code.endswith("{ let c = '{'; }")


def test_positions_give_the_code():
    text = "package p\r\n\r\nfunc A() interface{} {\r\n\treturn 1\r\n}\r// x\nfunc B() {\n"
    for d in scan(text, GO):
        assert newlines(text)[d.start : d.stop] == d.code


def test_broken_and_annotated_sources_take_linear_time():
    def took(n):
        text = "class A {\n" + "  /** Doc. */\n  @Override\n  public int f(int a) { return a; }\n" * n + "}\n"
        begun = time.perf_counter()
        assert len(scan(text, JAVA)) == n
        return time.perf_counter() - begun

    took(100)
    assert took(4000) < 12 * took(1000)
    begun = time.perf_counter()
    scan("func F(a [](\n" * 3000, GO)  # heads that never close
    assert time.perf_counter() - begun < 5


def test_echoes_are_learned(spark):
    """A word that declarations with a name part add alone to their names says the part again."""
    nouns = ["Vector", "Bucket", "Queue", "Caller", "Graph", "Import"]
    rows = [(f"function:p.New{n}", "function", f"New{n} makes the {n.lower()}.") for n in nouns] + [(f"function:p.New{n}s", "function", f"It allocates {n.lower()}s.") for n in nouns]
    rows += [("function:p.NewTree", "function", "NewTree makes and allocates trees."), ("function:p.DropTree", "function", "DropTree makes and allocates trees.")]
    nodes = spark.createDataFrame(rows, "id string, type string, documentation string").withColumn("created_at", F.lit(1))
    echo = learned_echoes(nodes)
    assert {"mak", "allocat"} <= set(echo["new"]) and "drop" not in echo
    files = spark.createDataFrame([(1, "p", "func NewTree() {}\nfunc DropTree() {}\n")], "file_id long, package string, content string")
    assert {r["id"] for r in documented_pairs(nodes, files).collect()} == {"function:p.DropTree"}
    assert learned_echoes(nodes.limit(0)) == {}


@pytest.mark.parametrize("doc", ["No documentation available.", "Description missing.", "Undocumented, see code.", "Auto-generated stub", "TBD: the whole of it is to be rewritten", "File generated by the graph tool from text."])
def test_words_about_documentation_are_trivial(doc):
    assert is_trivial(doc, "MergeNodes", "Store", "a []int")


@pytest.mark.parametrize("doc", ["O(n) in the number of users.", "Optimizes the order of keys.", "Review notes are kept sorted.", "Text generated from the index is cached."])
def test_true_statements_pass(doc):
    assert not is_trivial(doc, "CountNodes", "Store", "a []int")
