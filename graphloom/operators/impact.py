"""What a component touches and what touches it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph, named

#: fixed values: the edge types an impact is looked for on, and how each is reported when its target goes away
DELETE_TYPES = ("calls", "uses", "implements", "returns", "embeds", "constructs", "parameter_type", "imports")
GENERAL_TYPES = ("calls", "uses", "implements", "has_method", "method_of", "returns", "embeds", "constructs", "handles_error", "spawns_goroutine", "parameter_type", "imports")
IMPACT_NAMES = {
    "calls": "function_calls_deleted",
    "implements": "implements_deleted_interface",
    "embeds": "embeds_deleted_type",
    "imports": "imports_deleted_package",
    "returns": "returns_deleted_type",
    "constructs": "constructs_deleted_type",
    "parameter_type": "parameter_uses_deleted_type",
}
OTHER_IMPACT = "depends_on_deleted_node"


def impact_delete(g: CodeGraph, node: str, limit: int | None = 50) -> DataFrame:
    """Nodes that break if ``node`` goes away: one hop against eight edge types."""
    h = g.hop(*DELETE_TYPES, target_where=named(node))
    label = F.lit(OTHER_IMPACT)
    for kind, text in IMPACT_NAMES.items():
        label = F.when(F.col("type") == kind, text).otherwise(label)
    out = h.select(
        F.col("s_id").alias("affectedNode"), F.col("s_type").alias("nodeType"), F.col("s_label").alias("name"), F.col("s_package").alias("package"), F.col("type").alias("dependency_type"), label.alias("impact_type")
    ).distinct()
    return out.orderBy("nodeType", "dependency_type", "affectedNode").limit(limit) if limit else out


def impact_general(g: CodeGraph, node: str, limit: int | None = 50) -> DataFrame:
    """Nodes one hop from ``node`` in either direction over twelve edge types."""
    h = g.around(*GENERAL_TYPES, source_where=named(node))
    out = h.select(F.col("t_id").alias("relatedNode"), F.col("t_type").alias("nodeType"), F.col("t_label").alias("name"), F.col("t_package").alias("package"), F.col("type").alias("relationship_type")).distinct()
    return out.orderBy("nodeType", "relatedNode", "relationship_type").limit(limit) if limit else out


def analyze_impact(g: CodeGraph, node: str, change_type: str = "modify") -> DataFrame:
    return impact_delete(g, node) if (change_type or "").lower() == "delete" else impact_general(g, node)


def find_implementers(g: CodeGraph, interface: str | None = None) -> DataFrame:
    """Structs that implement the interfaces of a name; all interfaces without one."""
    h = g.hop("implements", source=("struct",), target=("interface",), target_where=None if interface is None else named(interface))
    return h.select(F.col("s_full_name").alias("implementer"), F.col("s_package").alias("package"), F.col("s_label").alias("name"), F.col("t_full_name").alias("interface")).distinct()


def neighbourhood(g: CodeGraph, node: str) -> DataFrame:
    h = g.around(source_where=F.col("id") == node)
    return h.select(F.col("t_id").alias("neighbour"), F.col("t_label").alias("label"), F.col("type").alias("relationship")).distinct()


def incident_types(g: CodeGraph, node: str) -> DataFrame:
    """Incident relationship types of a node and how many edges each has."""
    return g.around(source_where=named(node)).groupBy("type").agg(F.count(F.lit(1)).alias("edges"))


def component_callers(g: CodeGraph, name: str) -> DataFrame:
    hit = named(name) | F.col("full_name").endswith("." + name)
    h = g.hop("calls", target_where=hit)
    return h.select(F.col("s_id").alias("caller"), F.col("s_package").alias("package"), F.col("t_id").alias("callee")).distinct()


def interface_impact(g: CodeGraph, name: str) -> DataFrame:
    h = g.around("implements", "uses", "parameter_type", "returns", source_where=named(name) & (F.col("type") == "interface"))
    return h.select(F.col("t_id").alias("related"), F.col("t_type").alias("nodeType"), F.col("type").alias("relationship")).distinct()


def type_dependents(g: CodeGraph, name: str) -> DataFrame:
    h = g.hop("uses", "parameter_type", "returns", "field_type", "embeds", "constructs", target_where=named(name))
    return h.select(F.col("s_id").alias("dependent"), F.col("s_type").alias("nodeType"), F.col("type").alias("relationship")).distinct()


def forward_imports(g: CodeGraph, package: str) -> DataFrame:
    h = g.hop("imports", source_where=F.col("package").contains(package))
    return h.select(F.col("s_package").alias("package"), F.col("t_package").alias("imports")).where(F.col("imports") != F.col("package")).distinct()


def reverse_imports(g: CodeGraph, package: str) -> DataFrame:
    h = g.hop("imports", target_where=F.col("package").contains(package))
    return h.select(F.col("s_package").alias("importer"), F.col("t_package").alias("package")).where(F.col("importer") != F.col("package")).distinct()


def interface_returners(g: CodeGraph, name: str | None = None) -> DataFrame:
    where: Column = F.col("type") == "interface"
    h = g.hop("returns", target_where=where if name is None else where & named(name))
    return h.select(F.col("s_id").alias("function"), F.col("s_signature").alias("signature"), F.col("t_label").alias("interface")).distinct()


def interface_takers(g: CodeGraph, name: str | None = None) -> DataFrame:
    where: Column = F.col("type") == "interface"
    h = g.hop("parameter_type", target_where=where if name is None else where & named(name))
    return h.select(F.col("s_id").alias("function"), F.col("s_signature").alias("signature"), F.col("t_label").alias("interface")).distinct()


def test_callers(g: CodeGraph, prefix: str = "Test", package: str | None = None, name: str | None = None) -> DataFrame:
    """Functions, of a package or a name if given, that functions of a name prefix call, in any letter case."""
    starts = F.lower("label").startswith(prefix.lower())
    wanted = F.lit(True) if package is None else F.col("package") == package
    h = g.hop("calls", source_where=starts, target_where=wanted if name is None else wanted & named(name))
    return h.groupBy(F.col("t_id").alias("tested")).agg(F.countDistinct("s_id").alias("tests"))


def public_functions(g: CodeGraph, package: str | None = None) -> DataFrame:
    f = g.of("function", "method").where(F.col("visibility") == "public")
    f = f if package is None else f.where(F.col("package") == package)
    return f.select("id", "label", "package", "complexity", "signature")


def dependency_suffix(g: CodeGraph, suffix: str = "/common") -> DataFrame:
    """Packages that import a package whose path ends in ``suffix``."""
    return g.hop("imports", target_where=F.col("package").endswith(suffix)).select(F.col("s_package").alias("importer")).distinct()
