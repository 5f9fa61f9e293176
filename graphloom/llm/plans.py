"""Queries of the text and vector problems (p1, p2, p6, p7, p8) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.documented import declarations, documented_pairs
from graphloom.llm.neighbours import Neighbours
from graphloom.llm.packing import pack
from graphloom.llm.reading import reading_levels
from graphloom.llm.tokenizer import count_tokens, decode_texts, encode_texts
from graphloom.shared import Scratch

NEIGHBOURS = 5
TOKENIZER = "byte_bpe_50k"
MIN_SIMILARITY = 0.9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_pairs(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "source_files")).select("id")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_pairs(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "source_files"))


def p1_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declaration of every file with its line and the hash of its code, as the text between its positions."""
    found = declarations(table(spark, sf_dir, "source_files"), "file_id", "package", "content")
    return found.select("file_id", "line", F.md5("code").alias("code_md5"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _neighbours(spark, sf_dir).top(NEIGHBOURS, MIN_SIMILARITY)
    return top.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).top(NEIGHBOURS, MIN_SIMILARITY).withColumn("similarity", F.round("similarity", 6))


def _neighbours(spark: SparkSession, sf_dir: str) -> Neighbours:
    return Neighbours(table(spark, sf_dir, "existing_nodes"), F.col("id"), F.col("embedding_model"), F.col("embedding"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every text as it comes back from its ids."""
    return decode_texts(p6_ids(spark, sf_dir), "ids").select("doc_id", F.md5("text").alias("text_md5"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of every capacity of pack_limits, measured with the tokenizer named there, or with
    TOKENIZER where none is; limits without a capacity have no containers."""
    limits = [(r["limit_no"], r["tokenizer"] or TOKENIZER, r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_limits").distinct().collect()]  # a fixed table of three rows
    out = None
    for tokenizer in sorted({t for _, t, c in limits if c}):
        counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer=tokenizer)
        sizes, seen, _ = Scratch(spark, "packing").cut(counted, tokens=F.sum("n_tokens"), count=F.count(F.lit(1)))
        own = sorted((n, c) for n, t, c in limits if t == tokenizer and c)
        packed = pack(sizes, own, "doc_id", "n_tokens", tokens=int(seen["tokens"]), count=int(seen["count"]))
        out = packed if out is None else out.unionAll(packed)
    if out is None:
        return spark.createDataFrame([], "limit_no int, container_id string, doc_id long, part_no int, start long, n_tokens long")
    return out


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the share of their room that is filled, of each capacity."""
    limits = table(spark, sf_dir, "pack_limits").select("limit_no", "capacity_tokens").distinct()
    used = p7_containers(spark, sf_dir).groupBy("limit_no").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(limits, "limit_no").select("limit_no", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each limit: documents packed, tokens too many or too few against their counts, containers beyond the capacity,
    texts cut although they fit, and parts that leave a gap or overlap."""
    limits = table(spark, sf_dir, "pack_limits").select("limit_no", "capacity_tokens", F.coalesce("tokenizer", F.lit(TOKENIZER)).alias("tokenizer")).distinct()
    packed, _, _ = Scratch(spark, "checks").cut(p7_containers(spark, sf_dir))
    over = packed.groupBy("limit_no", "container_id").agg(F.sum("n_tokens").alias("held")).join(limits, "limit_no").groupBy("limit_no").agg(F.sum((F.col("held") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    texts = packed.groupBy("limit_no", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.countDistinct("start").alias("starts"))
    counted = None
    for name in sorted(r[0] for r in limits.select("tokenizer").distinct().collect()):  # one row a tokenizer
        one = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer=name).withColumn("tokenizer", F.lit(name))
        counted = one if counted is None else counted.unionAll(one)
    met = texts.join(limits, "limit_no").join(counted, ["doc_id", "tokenizer"])
    flag = lambda c, name: F.sum(c.cast("long")).alias(name)
    per = met.groupBy("limit_no").agg(
        F.count(F.lit(1)).alias("documents"), flag(F.abs(F.col("tokens") - F.col("n_tokens")), "lost_tokens"), flag((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens")), "needless_cuts"),
        flag((F.col("end") != F.col("n_tokens")) | (F.col("starts") != F.col("parts")), "gaps"),
    )
    return per.join(over, "limit_no")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).where("demanding").select("doc_id")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_declarations, p2_found, p2_similar, p6_ids, p6_counts, p6_round_trip, p7_containers, p7_fill, p7_checks, p8_found, p8_levels)}
ALL_PAIRS = f"""
WITH v AS (SELECT id, embedding_model AS m, any_value(embedding::DOUBLE[]) AS e FROM existing_nodes WHERE len(embedding) > 0 AND id IS NOT NULL AND embedding_model IS NOT NULL
  AND NOT list_bool_or([isnan(x) for x in embedding]) AND list_bool_or([x <> 0 for x in embedding]) GROUP BY 1, 2),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.m = b.m AND a.id <> b.id AND len(a.e) = len(b.e)),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS k FROM s WHERE s >= {MIN_SIMILARITY})"""

#: p1_declarations: lines that begin a function outside comments and raw strings, up to the line that closes it at the
#: margin; p2_found: brute force over all pairs of a model
SQL = {
    "p1_declarations": r"""
WITH t AS (SELECT file_id, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM source_files WHERE content IS NOT NULL),
r0 AS (SELECT file_id, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM t),
r1 AS (SELECT *, regexp_replace(regexp_replace(s, '"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''', '_', 'g'), '//.*$', '') AS z FROM r0),
r AS (SELECT *, coalesce(sum(len(regexp_extract_all(z, '/\*')) - len(regexp_extract_all(z, '\*/'))) OVER w, 0) AS comments, coalesce(sum(len(regexp_extract_all(z, '`'))) OVER w, 0) % 2 AS raw
  FROM r1 WINDOW w AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT file_id, n, s FROM r WHERE regexp_matches(s, '^func\b') AND comments = 0 AND raw = 0),
e AS (SELECT file_id, n FROM r WHERE starts_with(s, '}')),
p AS (SELECT f.file_id, f.n AS line, CASE WHEN regexp_matches(any_value(f.s), '\}\s*$') THEN f.n ELSE min(e.n) END AS last FROM f LEFT JOIN e ON e.file_id = f.file_id AND e.n > f.n GROUP BY f.file_id, f.n)
SELECT p.file_id, line::INT AS line, md5(array_to_string(list_slice(l, line, last), chr(10))) AS code_md5 FROM p JOIN t USING (file_id)""",
    "p2_found": f"""
{ALL_PAIRS}
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= {NEIGHBOURS}""",
    "p2_similar": f"""
{ALL_PAIRS}
SELECT a AS id, b AS other, round(s, 6) AS similarity, k AS place FROM r WHERE k <= {NEIGHBOURS}""",
    # what every packing has to keep, whatever containers it makes
    "p7_checks": "SELECT DISTINCT limit_no, (SELECT count(*) FROM documents) AS documents, 0 AS lost_tokens, 0 AS needless_cuts, 0 AS gaps, 0 AS overfull FROM pack_limits WHERE capacity_tokens > 0",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
}
