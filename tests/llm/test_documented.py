import pytest

from graphloom.llm.documented import documented_pairs
from graphloom.llm.islands import GO, GRAMMARS, JAVA, JAVASCRIPT, PYTHON, RUST, scan
from graphloom.llm.triviality import is_trivial

SOURCE = "package p\r\n\r\n// Keeps the oldest entry on a tie.\r\nfunc (s *Store) Merge(a, b []int) (int, error) {\r\n\tx := `\nfunc Fake() {}\n`\n\tif a { /* } */ }\n\ts := \"}\" // {\n\treturn 0, nil\n}\n\n// far\n\nfunc Bare() {\n}\n/* Reads\n   all of it from disk. */\nfunc Read() {}\n// func Old() {\n// }\nvar y = 1 // trailing words that belong to y\nfunc Next() {\n"


def test_go_islands():
    found = {d.name: d for d in scan(SOURCE, GO)}
    assert list(found) == ["Merge", "Bare", "Read", "Next"]
    m = found["Merge"]
    assert m.receiver == "s *Store" and m.params == "a, b []int" and m.comment == "// Keeps the oldest entry on a tie." and m.line == 4
    assert m.code.startswith("func (s *Store)") and m.code.endswith("}") and "Fake" in m.code and "far" not in m.code
    assert found["Bare"].comment == "" and "disk" in found["Read"].comment and found["Next"].comment == ""
    assert found["Next"].code.startswith("func Next")


def test_other_grammars():
    java = scan('class A {\n  /** Adds two numbers with overflow. */\n  @Override\n  public int add(int a, int b) {\n    String s = "}";\n    return a + b;\n  }\n}\n', JAVA)
    assert [(d.name, d.params) for d in java] == [("add", "int a, int b")] and "overflow" in java[0].comment and java[0].code.endswith("}")
    js = scan("// Sums the list lazily.\nexport async function sum(xs) { return xs.map(x => `${x}}`) }\n", JAVASCRIPT)
    assert js[0].name == "sum" and "lazily" in js[0].comment
    rust = scan("/// Never blocks.\n#[inline]\npub fn go<T>(x: T) -> u8 { 1 }\n", RUST)
    assert rust[0].name == "go" and "blocks" in rust[0].comment
    py = scan('class A:\n    def f(self, x):\n        """Waits for x."""\n        return {"a": 1}\n\n    def g(self):\n        pass\n', PYTHON)
    assert [(d.name, d.comment) for d in py] == [("f", "Waits for x."), ("g", "")] and py[0].code.endswith('{"a": 1}')


@pytest.mark.parametrize("language", sorted(GRAMMARS))
@pytest.mark.parametrize("text", ["", " ", "{{{", "}}}", "/*", '"', "`", "func", "def", "func (", "public int f(", "\r", "fn x", '"""'])
def test_broken_sources_do_not_fail(language, text):
    scan(text, GRAMMARS[language])


TRIVIAL = ["", " \n", None, "TODO", "FIXME: write a comment", "MergeNodes merges nodes.", "The MergeNodes function merges the nodes.", "This function, MergeNodes, is the function which merges nodes, as its name says.", "// nolint:gocyclo", "go:generate stringer -type=Kind",
           "Code generated by x. DO NOT EDIT.", "------", "n/a", "/*\n * MergeNodes ...\n */", "@param a @param b @return", "func old(x int) error {", "return mapNode(nil), nil", "if err != nil { return err }", "Deprecated.", "see above", "TBD MergeNodes merges nodes.",
           "TODO: handle limits\nMergeNodes merges nodes.", "merge nodes!", "MergeNodes is a method of Store."]
TELLING = ["Not safe for concurrent use.", "MergeNodes merges nodes and keeps the oldest on a tie.", "TODO: tidy up\nReturns nil when the list is empty.", "Deprecated: prefer MergeAll, which reads the channel once.", "El cargador la omite y avisa.", "関数が見つからない場合は警告を出します。",
           "Danach prüft der Analysator, ob die Kante noch gebraucht wird.", "O(n) in the number of keys.", "nolint:gocyclo\nCallers must hold the lock of the index.", "Panics if the workspace was never loaded."]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert is_trivial(doc, "MergeNodes", "Store", "a []int, b int")


@pytest.mark.parametrize("doc", TELLING)
def test_telling(doc):
    assert not is_trivial(doc, "MergeNodes", "Store", "a []int, b int")


def test_pairs(spark):
    nodes = [("method:p.*p.Store.Merge", "METHOD ", None, 2), ("method:p.*p.Store.Merge", "method", " ", 1), ("function:p.Bare", "function", "Returns the sum of both sides.", 1), ("function:p.Read", "Function", "TODO", 1),
             ("function:p.Missing", "function", "Returns the sum of both sides.", 1), ("struct:p.Store", "struct", "Holds all of it for later.", 1), (None, "function", "x", 1)]
    n = spark.createDataFrame([(*x, "clash") for x in nodes], "id string, type string, documentation string, created_at int, code string")
    f = spark.createDataFrame([(1, "p", SOURCE, "x"), (2, "p", SOURCE, "y"), (3, "q", None, "z"), (4, "q", "", "z")], "file_id long, package string, content string, name string")
    got = {r["id"]: r for r in documented_pairs(n, f).collect()}
    assert set(got) == {"method:p.*p.Store.Merge", "function:p.Bare"}
    assert "oldest" in got["method:p.*p.Store.Merge"]["documentation"] and got["function:p.Bare"]["code"].startswith("func Bare")
    assert documented_pairs(n.limit(0), f).count() == 0 and documented_pairs(n, f.limit(0)).count() == 0
