"""Queries of the general data-processing problems (p3, p4, p5) over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.canonical import canonical_hex, present, stripped
from graphloom.operators.hierarchy import Forest, parent_child
from graphloom.operators.skew import edge_totals, heavy_keys
from graphloom.operators.snapshots import snapshot_changes

HEAVY_SHARE = 0.01
DEFAULT_DEPTH = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = edge_totals(table(spark, sf_dir, "edges"))
    return heavy_keys(totals, HEAVY_SHARE).select("target", "type")


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = edge_totals(table(spark, sf_dir, "edges"))
    return totals.where("target IS NOT NULL").select("target", "type", "edges", "weight", "sources")


def _forest(spark: SparkSession, sf_dir: str) -> Forest:
    return Forest(*parent_child(table(spark, sf_dir, "edges")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir).depths()


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, root, depth and number of descendants of every node, from the intervals; depth is -1 on and below loops."""
    return _forest(spark, sf_dir).nodes(loops=True).select("node_id", "parent_id", "root_id", "depth", "descendants")


def p4_extra_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to a second parent, which a forest has none of: what the hierarchy leaves out is told here."""
    return _forest(spark, sf_dir).extra_parents()


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every node from its root; on and below loops ``loop(...)`` marks the ids that are on the loop."""
    rest = F.slice("path", F.col("ring") + 1, F.size("path"))
    looped = F.concat(F.lit("loop("), F.array_join(F.slice("path", 1, F.col("ring")), " > "), F.lit(")"))
    looped = F.concat_ws(" > ", looped, F.when(F.size(rest) > 0, F.array_join(rest, " > ")))
    return _forest(spark, sf_dir).paths(loops=True).select("node_id", F.when(F.col("ring") > 0, looped).otherwise(F.array_join("path", " > ")).alias("path"))


def p4_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of the node of every request, on and below loops too, down to its max_depth; repeated requests count once."""
    asked = table(spark, sf_dir, "impact_requests").where("request_id IS NOT NULL").dropDuplicates()
    depth = F.when(F.col("max_depth") > 0, F.col("max_depth")).otherwise(F.lit(DEFAULT_DEPTH))
    return _forest(spark, sf_dir).descendants(asked, F.col("node_id"), depth, ["request_id"], loops=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "node_snapshots")
    key = F.when(present(F.col("id")), stripped(F.col("id")))
    changes = snapshot_changes(rows, F.col("workspace"), F.col("snapshot_no"), key, canonical_hex(F.col("semantic_hash")), F.col("loaded_at"))
    return changes.select(F.col("scope").alias("workspace"), "snapshot_no", F.col("key").alias("id"), "change")


def p5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, with the embedding model compared too, and which of the two differ."""
    rows = table(spark, sf_dir, "node_snapshots")
    key = F.when(present(F.col("id")), stripped(F.col("id")))
    changes = snapshot_changes(rows, F.col("workspace"), F.col("snapshot_no"), key, canonical_hex(F.col("semantic_hash")), F.col("loaded_at"), compare={"model": F.col("embedding_model")})
    return changes.select(F.col("scope").alias("workspace"), "snapshot_no", F.col("key").alias("id"), "change", F.array_join("columns", ",").alias("columns"))


KIND = r"lower(regexp_replace(regexp_replace(regexp_replace(type, '^\s+|\s+$', '', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[\s_-]+', '_', 'g'))"
SPACE = r"'^\s+|\s+$', '', 'g'"

P3_SQL = rf"""
WITH e AS (SELECT DISTINCT * FROM edges),
k AS (SELECT CASE WHEN regexp_matches(target, '\S') THEN regexp_replace(target, {SPACE}) END AS target, {KIND} AS type, weight,
      CASE WHEN regexp_matches(source, '\S') THEN regexp_replace(source, {SPACE}) END AS source FROM e),
t AS (SELECT target, type, count(*) AS edges, coalesce(sum(weight), 0)::BIGINT AS weight, count(DISTINCT source) AS sources FROM k GROUP BY 1, 2)
"""

LINKS = rf"""
typed AS (SELECT source, target, {KIND} AS kind FROM edges WHERE regexp_matches(source, '\S') AND regexp_matches(target, '\S')),
either AS (SELECT target AS child, source AS parent FROM typed WHERE kind IN ('has_method', 'has_field', 'has_parameter')
  UNION ALL SELECT source, target FROM typed WHERE kind IN ('method_of', 'embeds')),
links AS (SELECT child, min(parent) AS parent FROM either GROUP BY child),
ids AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
tree AS (SELECT id AS node_id, id AS root_id, 0 AS depth, CAST(NULL AS VARCHAR) AS parent_id, id AS path FROM ids WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, t.root_id, t.depth + 1, l.parent, t.path || ' > ' || l.child FROM tree t JOIN links l ON l.parent = t.node_id)"""

LOOPS = """
bad AS (SELECT child, parent FROM links WHERE child NOT IN (SELECT node_id FROM tree)),
walk AS (SELECT child AS node_id, child AS spot, 0 AS n FROM bad UNION ALL SELECT w.node_id, b.parent, n + 1 FROM walk w JOIN bad b ON b.child = w.spot WHERE n < 300),
onloop AS (SELECT DISTINCT node_id FROM walk WHERE n > 0 AND spot = node_id),
looped AS (SELECT node_id, min(spot) AS root_id FROM walk WHERE spot IN (SELECT node_id FROM onloop) GROUP BY node_id)"""

SQL = {
    "p3_found": P3_SQL + "SELECT target, type FROM t WHERE target IS NOT NULL AND edges >= 0.01 * (SELECT sum(edges) FROM t)",
    "p3_totals": P3_SQL + "SELECT * FROM t WHERE target IS NOT NULL",
    "p4_found": f"WITH RECURSIVE {LINKS}, {LOOPS} SELECT node_id, root_id, depth FROM tree UNION ALL SELECT node_id, root_id, -1 FROM looped",
    "p4_extra_parents": f"""WITH RECURSIVE {LINKS}
SELECT DISTINCT child AS node_id, e.parent AS parent_id, l.parent AS kept_id FROM either e JOIN links l USING (child) WHERE e.parent <> l.parent""",
    "p4_nodes": f"""WITH RECURSIVE {LINKS}, {LOOPS},
reach AS (SELECT child AS spot, parent AS top FROM links UNION SELECT r.spot, l.parent FROM reach r JOIN links l ON l.child = r.top),
cnt AS (SELECT top, count(*) FILTER (spot <> top) AS below FROM reach GROUP BY top),
every AS (SELECT node_id, parent_id, root_id, depth FROM tree UNION ALL SELECT node_id, parent, root_id, -1 FROM looped JOIN bad ON child = node_id)
SELECT node_id, parent_id, root_id, depth, coalesce(below, 0) AS descendants FROM every LEFT JOIN cnt ON top = node_id""",
    "p4_paths": f"""WITH RECURSIVE {LINKS}, {LOOPS},
ring AS (SELECT node_id, root_id FROM looped WHERE node_id IN (SELECT node_id FROM onloop)),
around AS (SELECT node_id, root_id, node_id AS path FROM ring WHERE node_id = root_id
  UNION ALL SELECT r.node_id, r.root_id, a.path || ' > ' || r.node_id FROM around a JOIN bad b ON b.parent = a.node_id JOIN ring r ON r.node_id = b.child WHERE r.node_id <> r.root_id),
hung AS (SELECT node_id, 'loop(' || path || ')' AS path FROM around
  UNION ALL SELECT b.child, h.path || ' > ' || b.child FROM hung h JOIN bad b ON b.parent = h.node_id WHERE b.child NOT IN (SELECT node_id FROM ring))
SELECT node_id, path FROM tree UNION ALL SELECT node_id, path FROM hung""",
    "p4_impact": f"""WITH RECURSIVE {LINKS},
asked AS (SELECT DISTINCT request_id, workspace, node_id, change_type, CASE WHEN max_depth > 0 THEN max_depth ELSE 5 END AS most, max_depth, asked_at FROM impact_requests WHERE request_id IS NOT NULL),
seeds AS (SELECT DISTINCT node_id AS seed FROM asked),
down AS (SELECT seed, seed AS id, 0 AS distance FROM seeds WHERE seed IN (SELECT id FROM ids)
  UNION ALL SELECT d.seed, l.child, d.distance + 1 FROM down d JOIN links l ON l.parent = d.id WHERE l.child <> d.seed)
SELECT request_id, id AS descendant_id, distance FROM asked JOIN down ON seed = node_id WHERE distance BETWEEN 1 AND most""",
    "p5_found": rf"""
WITH r AS (SELECT workspace, snapshot_no, loaded_at, regexp_replace(id, {SPACE}) AS id,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(semantic_hash, {SPACE})), '^[a-z0-9_-]+:', ''), '^0x', ''), '[\s:-]+', '', 'g'), '') AS h
  FROM node_snapshots WHERE workspace IS NOT NULL AND snapshot_no IS NOT NULL),
d AS (SELECT workspace, snapshot_no, lag(snapshot_no) OVER (PARTITION BY workspace ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT workspace, snapshot_no FROM r)),
o AS (SELECT *, row_number() OVER (PARTITION BY workspace, snapshot_no, id ORDER BY loaded_at DESC NULLS LAST, h DESC NULLS LAST) AS n FROM r WHERE id <> ''),
s AS (SELECT workspace, snapshot_no, id, h FROM o WHERE n = 1 AND h IS NOT NULL),
new AS (SELECT s.*, d.before FROM s JOIN d USING (workspace, snapshot_no) WHERE d.before IS NOT NULL),
old AS (SELECT d.workspace, d.snapshot_no, s.id, s.h FROM s JOIN d ON d.workspace = s.workspace AND d.before = s.snapshot_no)
SELECT coalesce(new.workspace, old.workspace) AS workspace, coalesce(new.snapshot_no, old.snapshot_no) AS snapshot_no, coalesce(new.id, old.id) AS id,
  CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new FULL JOIN old ON new.workspace = old.workspace AND new.snapshot_no = old.snapshot_no AND new.id = old.id
WHERE old.h IS NULL OR new.h IS NULL OR old.h <> new.h""",
    "p5_columns": rf"""
WITH r AS (SELECT workspace, snapshot_no, loaded_at, regexp_replace(id, {SPACE}) AS id,
  embedding_model AS m, nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(semantic_hash, {SPACE})), '^[a-z0-9_-]+:', ''), '^0x', ''), '[\s:-]+', '', 'g'), '') AS h
  FROM node_snapshots WHERE workspace IS NOT NULL AND snapshot_no IS NOT NULL),
d AS (SELECT workspace, snapshot_no, lag(snapshot_no) OVER (PARTITION BY workspace ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT workspace, snapshot_no FROM r)),
o AS (SELECT *, row_number() OVER (PARTITION BY workspace, snapshot_no, id ORDER BY loaded_at DESC NULLS LAST, h DESC NULLS LAST, m DESC NULLS LAST) AS n FROM r WHERE id <> ''),
s AS (SELECT workspace, snapshot_no, id, h, m FROM o WHERE n = 1 AND h IS NOT NULL),
new AS (SELECT s.*, d.before FROM s JOIN d USING (workspace, snapshot_no) WHERE d.before IS NOT NULL),
old AS (SELECT d.workspace, d.snapshot_no, s.id, s.h, s.m FROM s JOIN d ON d.workspace = s.workspace AND d.before = s.snapshot_no)
SELECT coalesce(new.workspace, old.workspace) AS workspace, coalesce(new.snapshot_no, old.snapshot_no) AS snapshot_no, coalesce(new.id, old.id) AS id,
  CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN old.h IS NULL OR new.h IS NULL THEN '' ELSE concat_ws(',', CASE WHEN old.h <> new.h THEN 'state' END, CASE WHEN old.m IS DISTINCT FROM new.m THEN 'model' END) END AS columns
FROM new FULL JOIN old ON new.workspace = old.workspace AND new.snapshot_no = old.snapshot_no AND new.id = old.id
WHERE old.h IS NULL OR new.h IS NULL OR old.h <> new.h OR old.m IS DISTINCT FROM new.m""",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_totals, p4_found, p4_nodes, p4_paths, p4_impact, p4_extra_parents, p5_found, p5_columns)}
