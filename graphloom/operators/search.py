"""Text and vector search over a code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph


def search_scores(g: CodeGraph, query: str) -> DataFrame:
    """id, label, score of the nodes that hold ``query`` in label, type, package or signature, in any letter case."""
    q = query.lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    match = low("label").contains(q) | low("type").contains(q) | low("package").contains(q) | low("signature").contains(q)
    plus = lambda cond, n: F.when(cond, n).otherwise(0)
    either = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c))
    score = plus(low("label") == q, 100) + plus(low("label").startswith(q), 50) + plus(low("type") == q, 80) + either("complexity") * 2 + either("size")
    return g.nodes.where(match).select("id", "label", score.alias("score"))


def search(g: CodeGraph, query: str, limit: int = 10) -> DataFrame:
    return search_scores(g, query).orderBy(F.desc("score"), "id").limit(limit)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a constant vector inside code generation; null where lengths differ or a norm is 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((F.size(vector) == len(query)) & (norm > 0), dot / (norm * own))


def vector_topk(rows: DataFrame, id_: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """id, score of the k vectors of greatest cosine; each partition keeps k rows, so one small merge follows."""
    score = cosine(F.col(vector), query)
    scored = rows.select(F.col(id_).alias("id"), score.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(g: CodeGraph, vectors: DataFrame, query: list[float], k: int = 10, limit: int = 20) -> DataFrame:
    """The k nearest nodes with all their neighbours: id, score, related (a set of structs) and connectivity (edges).

    The k best are taken before any join; nodes without neighbours stay with connectivity 0.
    """
    best = vector_topk(vectors, "id", "embedding", query, k)
    near = best.join(g.nodes.select("id", "label", "type", "package"), "id")
    e = g.undirected().select(F.col("source").alias("id"), F.col("target").alias("other"), F.col("type").alias("rel"))
    around = near.join(F.broadcast(near.select(F.col("id").alias("nid"))), F.col("id") == F.col("nid")).select("id")  # at most k rows
    met = e.join(around, "id", "left_semi").join(g.nodes.select(F.col("id").alias("other"), F.col("label").alias("o_label"), F.col("type").alias("o_type")), "other")
    per = met.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(F.col("other").alias("id"), F.col("o_label").alias("label"), F.col("o_type").alias("type"), F.col("rel").alias("relationship")))).alias("r"), F.count(F.lit(1)).alias("connectivity"))
    out = near.join(per, "id", "left").select("id", "label", "type", "package", "score", F.coalesce("r", F.array()).alias("related"), F.coalesce("connectivity", F.lit(0)).alias("connectivity"))
    return out.orderBy(F.desc("score"), F.desc("connectivity"), "id").limit(limit)


def fulltext(g: CodeGraph, terms: str) -> DataFrame:
    """Nodes whose label, full name or summary hold every term as a word part."""
    text = F.lower(F.concat_ws(" ", "label", "full_name", "semantic_summary"))
    hit = F.lit(True)
    for t in terms.lower().split():
        hit = hit & text.contains(t)
    return g.nodes.where(hit).select("id", "label", "type")
