"""Code-description pairs: functions and methods with the documentation that tells something about them."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.canonical import canonical_type, present
from graphloom.llm.islands import GRAMMARS, Declaration, scan
from graphloom.llm.triviality import echoes, is_trivial, name_stems

FIELDS = ["decl_id", "kind", "name", "receiver", "params", "signature", "comment", "code", "line"]
#: a word says a part of a name again if it is what this share of the declarations with the part add alone to it, and
#: these are at least so many; parts of names rarer than this share of all declarations have no such words
ECHO_SHARE, ECHO_LEAST, PART_SHARE = 0.01, 3, 0.001


def declaration_id(package: str, d: Declaration) -> tuple[str, str, str]:
    """(id, kind, receiver type) by the id grammar of the graph: methods carry the qualified receiver with its star."""
    if not d.receiver:
        return f"function:{package}.{d.name}" if package else f"function:{d.name}", "function", ""
    kind = d.receiver.split()[-1] if "[" not in d.receiver else d.receiver.split("[")[0].split()[-1]
    star = "*" if kind.startswith("*") else ""
    bare = kind.lstrip("*").split("[")[0]
    return f"method:{package}.{star}{package}.{bare}.{d.name}", "method", bare


def declarations(files: DataFrame, key: str, package: str, content: str, *, language: str = "go") -> DataFrame:
    """One row per declaration of every file: ``key`` and decl_id, kind, name, receiver, params, signature, comment
    (the comments without a gap above it, or the docstring), code, line.

    Null, empty and blank contents give no rows; mixed line ends count as line ends; files delivered again give their
    declarations again. Extra columns are not read.
    """
    if language not in GRAMMARS:
        raise ValueError(f"no grammar for {language}: {', '.join(GRAMMARS)}")
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = GRAMMARS[language]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                where, rows = [], []
                for i, (pkg, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for d in scan(text or "", grammar):
                        id_, what, bare = declaration_id(pkg or "", d)
                        where.append(i)
                        rows.append((id_, what, d.name, bare, d.params, d.signature, d.comment, d.code, d.line))
                kinds = [pa.string()] * 8 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where, pa.int64())), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(9)]], names=[key, *FIELDS])

    schema = f"`{key}` {kind}, decl_id string, kind string, name string, receiver string, params string, signature string, comment string, code string, line int"
    return files.select(key, package, content).mapInArrow(run, schema)


def learned_echoes(nodes: DataFrame) -> dict[str, frozenset[str]]:
    """Stems that say a name part again, learned from the documentation of all function and method nodes.

    Only parts in PART_SHARE of the declarations and words in ECHO_SHARE of a part's are kept, so that the result has at
    most (parts a name) / PART_SHARE / ECHO_SHARE entries whatever the size of the corpus.
    """
    told = nodes.where(canonical_type(F.col("type")).isin("function", "method") & F.col("id").isNotNull() & present(F.col("documentation"))).select("id", "documentation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = id_.rsplit(".", 1)[-1]
                found = echoes(doc, name)
                rows += [(id_, part, word) for part, word in found]
                rows += [(id_, part, None) for part in name_stems(name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["id", "part", "word"])

    said = told.mapInArrow(run, "id string, part string, word string").groupBy("part", "word").agg(F.approx_count_distinct("id", 0.02).alias("n"))
    total = F.sum(F.when(F.col("word").isNull(), F.col("n"))).over(Window.partitionBy("part"))
    counted = said.withColumn("of", total).where(F.col("word").isNotNull() & (F.col("n") >= ECHO_LEAST) & (F.col("n") >= ECHO_SHARE * F.col("of")))
    every = told.agg(F.count(F.lit(1))).first()[0]
    found: dict[str, set[str]] = {}
    for r in counted.where(F.col("of") >= PART_SHARE * every).select("part", "word").collect():
        found.setdefault(r["part"], set()).add(r["word"])
    return {part: frozenset(words) for part, words in found.items()}


def documented_pairs(nodes: DataFrame, files: DataFrame, *, language: str = "go") -> DataFrame:
    """id, kind, signature, documentation, code of every function and method node whose declaration stands in a file
    and whose documentation is not trivial.

    * The documentation is the node's, or where that is null or blank the comment above the declaration.
    * A node given several times counts once, with its earliest documentation that is not blank; of several equal or
      different declarations of one id the one of the smallest file id holds. Null ids take no part.
    * ``type`` is read in any usual form. Empty tables give no rows; extra columns are not read.
    """
    echo = learned_echoes(nodes)

    def tells(doc: pd.Series, name: pd.Series, receiver: pd.Series, params: pd.Series) -> pd.Series:
        return pd.Series([not is_trivial(d, n or "", r, p, echo) for d, n, r, p in zip(doc, name, receiver, params, strict=True)], dtype=bool)

    found = declarations(files, "file_id", "package", "content", language=language)
    top = F.struct("file_id", "line", "name", "receiver", "params", "signature", "comment", "code")
    first = found.groupBy("decl_id").agg(F.min(top).alias("d"))
    doc: Column = F.when(present(F.col("documentation")), F.col("documentation"))
    wanted = nodes.where(canonical_type(F.col("type")).isin("function", "method") & F.col("id").isNotNull())
    given = wanted.select("id", canonical_type(F.col("type")).alias("kind"), doc.alias("doc"), "created_at")
    stamp = F.when(F.col("doc").isNotNull(), F.struct("created_at", "doc"))
    given = given.groupBy("id").agg(F.min("kind").alias("kind"), F.min(stamp).alias("s"))
    both = given.join(first, given["id"] == first["decl_id"])
    text = F.coalesce(F.col("s.doc"), F.when(present(F.col("d.comment")), F.col("d.comment")))
    rows = both.select("id", "kind", F.col("d.signature").alias("signature"), text.alias("documentation"), F.col("d.code").alias("code"), F.col("d.name").alias("n"), F.col("d.receiver").alias("r"), F.col("d.params").alias("p"))
    rows = rows.where(F.col("documentation").isNotNull())
    return rows.where(F.pandas_udf(tells, T.BooleanType())("documentation", "n", "r", "p")).select("id", "kind", "signature", "documentation", "code")
