import pytest
from pyspark.sql import functions as F

from graphloom.sources.go_extract import analyze_codebase, external, module_path
from graphloom.sources.go_parser import file_facts, lex

BASIC = """package basic

import (
	"errors"
	"fmt"
	str "strings"
	"shop/store"
)

// Reader reads.
type Reader interface {
	Read(p []byte) (int, error)
}

type ReadCloser interface {
	Reader
	Close() error
}

type Empty interface{}

type Base struct {
	ID   int `json:"id"`
	Name, Alias string
}

type File struct {
	Base
	*Extra
	path string
	opts map[string][]int
}

type Extra struct{}

func (f *File) Read(p []byte) (int, error) { return 0, nil }
func (f *File) Close() error {
	if err := check(f.path); err != nil {
		return fmt.Errorf("close: %w", err)
	}
	return nil
}

// NewFile opens
// a file.
func NewFile(path string, n, m int) (*File, error) {
	f := &File{path: path}
	f.Close()
	var b Base
	_ = b.ID
	if f != nil && n > 0 {
		for i := 0; i < n; i++ {
			switch i {
			case 1:
			}
		}
	}
	go check(path)
	go func() { check("x") }()
	if err := check(path); err != nil && n > 1 {
		return nil, errors.New(`func Fake() {`)
	}
	return f, nil
}

func check(path string) error { return nil }

func Use() {
	f, err := NewFile("a", 1, 2)
	if err != nil {
		return
	}
	f.Close()
	s := store.Open(str.ToLower("x"))
	s.Put(1)
	recur()
}

func recur() { recur() }

func Max[T int | float64](a, b T) T { return a }
"""
STORE = """package store

type Store struct{ n int }

func Open(name string) *Store { return &Store{n: 1} }

func (s *Store) Put(v int) { s.n = v }

func (s *Store) Close() error { return nil }
"""


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("mod")
    (root / "go.mod").write_text("module shop\n\ngo 1.22\n")
    for name, text in (("basic/basic.go", BASIC), ("store/store.go", STORE)):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    g = analyze_codebase(spark, str(root))
    nodes = {r["id"]: r for r in g.nodes.collect()}
    edges = [tuple(r) for r in g.edges.select("source", "target", "type").collect()]
    return nodes, edges


def test_node_ids(graph):
    nodes, _ = graph
    for i in ("package:shop/basic", "struct:shop/basic.File", "interface:shop/basic.Reader", "function:shop/basic.NewFile", "method:shop/basic.*shop/basic.File.Read", "field:shop/basic.File.path",
              "field:shop/basic.Base.Alias", "field:shop/basic.File.Extra", "parameter:shop/basic.NewFile.m", "interface:builtin.error", "struct:builtin.int"):
        assert i in nodes, i
    f = nodes["function:shop/basic.NewFile"]
    assert f["signature"] == "NewFile(path string, n int, m int) (*File, error)"
    assert f["documentation"] == "NewFile opens a file." and f["visibility"] == "public"
    assert f["complexity"] == 1 + 3 + 1 + 2 - 0 and f["size"] == f["complexity"] + 5
    assert nodes["struct:shop/basic.Base"]["size"] == 2 * 3 + 8 and nodes["interface:shop/basic.Reader"]["size"] == 3 + 5
    assert nodes["method:shop/basic.*shop/basic.File.Close"]["full_name"] == "shop/basic.Close"
    assert len([i for i in nodes if ":builtin" in i]) == 22
    assert "function:shop/basic.Fake" not in nodes


def test_edges(graph):
    _, edges = graph
    has = lambda s, t, k: (s, t, k) in edges
    p, m = "function:shop/basic.", "method:shop/basic.*shop/basic.File."
    assert has("package:shop/basic", "package:shop/store", "imports") and not any(t == "package:fmt" for _, t, _ in edges)
    assert has("struct:shop/basic.File", "struct:shop/basic.Base", "embeds") and not has("struct:shop/basic.File", "struct:shop/basic.Extra", "embeds")
    assert has("interface:shop/basic.ReadCloser", "interface:shop/basic.Reader", "embeds")
    assert has(p + "NewFile", m + "Close", "calls") and has(p + "Use", m + "Close", "calls")
    assert has(p + "Use", "function:shop/store.Open", "calls") and has(p + "Use", "method:shop/store.*shop/store.Store.Put", "calls")
    assert has(p + "recur", p + "recur", "calls")
    assert edges.count((p + "NewFile", p + "check", "spawns_goroutine")) == 2
    assert edges.count((p + "NewFile", p + "check", "calls")) == 3
    assert has(m + "Close", m + "Close", "handles_error") and has(m + "Close", m + "Close", "wraps_error")
    assert not has(p + "NewFile", p + "NewFile", "handles_error") and has(p + "Use", p + "Use", "handles_error")
    assert has(p + "NewFile", "struct:shop/basic.File", "constructs") and has(p + "NewFile", "struct:shop/basic.File", "returns")
    assert has(p + "NewFile", "struct:builtin.string", "parameter_type") and has(p + "check", "interface:builtin.error", "returns")
    assert has(m + "Read", "struct:shop/basic.File", "method_of") and has("struct:shop/basic.File", m + "Read", "has_method")
    assert has(p + "NewFile", "struct:shop/basic.Base", "uses") and has(p + "NewFile", "struct:shop/basic.File", "uses")
    assert has("struct:shop/basic.File", "interface:shop/basic.Reader", "implements") and has("struct:shop/basic.File", "interface:shop/basic.ReadCloser", "implements")
    assert not has("struct:shop/store.Store", "interface:shop/basic.Reader", "implements") and has("struct:shop/store.Store", "interface:shop/basic.Empty", "implements")
    assert has("struct:shop/basic.File", "field:shop/basic.File.opts", "has_field") and has(p + "NewFile", "parameter:shop/basic.NewFile.n", "has_parameter")


def test_bad_files():
    assert [r["kind"] for r in file_facts("p", "f.go", "no go at all")] == ["bad"]
    assert file_facts("p", "f.go", "package p\nfunc (")[0]["kind"] in ("file", "bad")
    assert lex("")[0][-1].text == ";"


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        analyze_codebase(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        analyze_codebase(spark, str(tmp_path))
    assert module_path(str(tmp_path)) == ""


def test_external(spark):
    paths = ["main", "fmt", "net/http", "github.com/a/b", "golang.org/x/y", "shop/store", "gopkg.in/yaml"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", external(F.col("p"), "shop").alias("e")).collect()
    assert {r["p"]: r["e"] for r in rows} == {"main": False, "fmt": True, "net/http": False, "github.com/a/b": True, "golang.org/x/y": True, "shop/store": False, "gopkg.in/yaml": True}


def test_promotion_through_deep_embedding(spark, tmp_path):
    """Methods climb through any number of embeddings, in structs and in interfaces; embedding in a ring ends."""
    deep = 9
    structs = "type S0 struct{}\n\nfunc (s S0) Go() error { return nil }\n\n" + "\n".join(f"type S{i} struct {{\n\tS{i - 1}\n}}\n" for i in range(1, deep))
    faces = "type I0 interface {\n\tGo() error\n}\n\n" + "\n".join(f"type I{i} interface {{\n\tI{i - 1}\n}}\n" for i in range(1, deep))
    ring = "type A struct {\n\t*B\n}\n\ntype B struct {\n\t*A\n}\n"
    (tmp_path / "go.mod").write_text("module m\n")
    (tmp_path / "a.go").write_text(f"package m\n\n{structs}\n{faces}\n{ring}")
    edges = analyze_codebase(spark, str(tmp_path)).edges.where("type = 'implements'").select("source", "target").distinct().collect()
    found = {(r["source"].rsplit(".", 1)[-1], r["target"].rsplit(".", 1)[-1]) for r in edges}
    assert {(f"S{i}", f"I{j}") for i in range(deep) for j in range(deep)} <= found
    assert not any(s in ("A", "B") and t.startswith("I") for s, t in found)
