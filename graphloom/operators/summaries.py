"""Semantic summaries and the hashes over them, as column expressions and one gathering join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph

MOST_ITEMS = 5
MOST_BYTES = 200


def clean_documentation(c: Column) -> Column:
    """White space collapsed, cut at 200 bytes: after the last full stop in them, else with dots. Null becomes ''."""
    one = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \n\t\r]+", " "))
    # a cut may fall inside a character: what is left of it is no valid UTF-8 and goes
    first = lambda n: F.rtrim(F.make_valid_utf8(F.substring(F.encode(one, "UTF-8"), 1, n).cast("string")), F.lit("\ufffd"))
    head = first(MOST_BYTES)
    back = F.locate(" .", F.reverse(head), 1)
    stop = F.length(head) - back  # characters up to the last full stop that a blank follows
    cut = F.when((back > 0) & (stop > 1), F.substr(head, F.lit(1), stop)).otherwise(F.concat(first(MOST_BYTES - 3), F.lit("...")))
    return F.when(F.octet_length(one) <= MOST_BYTES, one).otherwise(cut)


def summarize_list(items: Column, most: int = MOST_ITEMS) -> Column:
    """"a, b" or "a, b and K more" of an array."""
    more = F.concat(F.array_join(F.slice(items, 1, most), ", "), F.lit(" and "), (F.size(items) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(items) <= most, F.array_join(items, ", ")).otherwise(more)


def related_labels(g: CodeGraph) -> DataFrame:
    """id with sorted distinct labels of what it calls, uses, returns and implements, and two flags; one pass over E."""
    e = g.rel("calls", "uses", "returns", "implements", "handles_error", "spawns_goroutine").select("source", "target", "type")
    t = e.join(g.nodes.select(F.col("id").alias("k"), F.col("label").alias("t_label")), F.col("target") == F.col("k"))
    pick = lambda kind: F.sort_array(F.collect_set(F.when(F.col("type") == kind, F.col("t_label")))).alias(f"l_{kind}")
    flag = lambda kind: F.max(F.col("type") == kind).alias(f"f_{kind}")
    return t.groupBy(F.col("source").alias("sid")).agg(*[pick(k) for k in ("calls", "uses", "returns", "implements")], flag("handles_error"), flag("spawns_goroutine"))


def semantic_summaries(g: CodeGraph) -> DataFrame:
    """id, summary, semantic_hash, content_hash of functions, methods, structs and interfaces.

    Parts are joined by ". "; lists are in order of their labels, since edges have no order of their own.
    """
    n = g.of("function", "method", "struct", "interface")
    r = n.join(related_labels(g), F.col("id") == F.col("sid"), "left")
    doc = clean_documentation(F.col("documentation"))
    some = lambda c, word, text: F.when(F.size(c) > 0, F.concat(F.lit(word + ": "), text(F.col(c))))
    every = lambda c: F.array_join(c, ", ")
    called = F.col("type").isin("function", "method")
    parts = [
        F.concat_ws(" ", "type", "label", F.lit("in"), F.coalesce("package", F.lit(""))),
        F.when(doc != "", doc),
        F.when(called & (F.coalesce(F.col("signature"), F.lit("")) != ""), F.col("signature")),
        some("l_calls", "calls", summarize_list),
        some("l_uses", "uses", summarize_list),
        some("l_returns", "returns", every),
        some("l_implements", "implements", every),
        F.when(F.col("f_handles_error"), F.lit("handles errors")),
        F.when(F.col("f_spawns_goroutine"), F.lit("spawns goroutines")),
        F.when(called & (F.col("complexity") > 10), F.concat(F.lit("complexity "), F.col("complexity").cast("string"))),
    ]
    s = r.withColumn("summary", F.concat_ws(". ", *parts))
    return s.select("id", "summary", semantic_hash(F.col("summary")).alias("semantic_hash"), content_hash().alias("content_hash"))


def semantic_hash(summary: Column) -> Column:
    return F.sha2(F.coalesce(summary, F.lit("")), 256)


def content_hash() -> Column:
    """Hash over signature, type, visibility, size, complexity and file name of a node row."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", *[text(F.col(c)) for c in ("signature", "type", "visibility", "size", "complexity")], text(F.col("position.filename"))), 256)


def hash_metadata(metadata: Column, content: Column, semantic: Column, has_embedding: Column, analyzed: Column) -> Column:
    """The node's metadata map with hashes and analysis time added."""
    extra = F.create_map(F.lit("content_hash"), content, F.lit("semantic_hash"), semantic, F.lit("has_embedding"), has_embedding.cast("string"), F.lit("last_analyzed"), F.unix_timestamp(analyzed).cast("string"))
    base = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("content_hash", "semantic_hash", "has_embedding", "last_analyzed"))
    return F.map_concat(base, extra)


def node_metadata(metadata: Column) -> Column:
    """Only the five hash and embedding keys."""
    return F.map_filter(metadata, lambda k, _: k.isin("content_hash", "semantic_hash", "has_embedding", "last_analyzed", "embedding_generated_at"))


def needs_embedding(semantic: Column, stored_hash: Column, stored_embedding: Column) -> Column:
    """True where nothing is stored, the hash differs or the stored vector is empty."""
    same = stored_hash.isNotNull() & (stored_hash == semantic) & (F.coalesce(F.size(stored_embedding), F.lit(0)) > 0)
    return ~F.coalesce(same, F.lit(False))


def workspace_name(module: Column, directory: Column) -> Column:
    """Last segment of the module path, else of the directory, as an identifier; 'workspace' if nothing is left."""
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    base = F.coalesce(F.when(F.coalesce(module, F.lit("")) != "", last(module)), last(directory), F.lit(""))
    clean = F.regexp_replace(base, "[^A-Za-z0-9_-]", "_")
    return F.when(clean == "", "workspace").when(clean.rlike("^[0-9]"), F.concat(F.lit("ws_"), clean)).otherwise(clean)


def rel_name(c: Column) -> Column:
    """Relationship name of a type: leading digits dropped, words of - _ and blanks in Pascal case."""
    words = F.filter(F.split(F.regexp_replace(c, "^[0-9]+", ""), r"[-_ ]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def prefixed(workspace: str, c: Column) -> Column:
    return F.concat(F.lit(workspace + ":"), c)
