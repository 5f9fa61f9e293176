"""Questions in plain words to graph queries: an ordered table of rules, the first whose words occur wins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphloom.graph import CodeGraph
from graphloom.operators import patterns

#: fixed values: how a name part is asked for, and the words that name kinds of interfaces
NAME_PATTERNS = (r"with (\w+) in their name", r"containing (\w+)", r"named (\w+)", r"that have (\w+)", r"includes (\w+)")
INTERFACE_WORDS = ("checkout", "repository", "service", "client", "handler", "manager")


@dataclass(frozen=True)
class Plan:
    """What a question was understood as."""

    rule: str
    build: Callable[[CodeGraph], DataFrame]

    def run(self, g: CodeGraph) -> DataFrame:
        return self.build(g)


def name_part(question: str) -> str | None:
    for p in NAME_PATTERNS:
        if m := re.search(p, question):
            return m.group(1)
    return None




def route(question: str) -> Plan:
    """The plan of a question. White space around it and letter case don't matter; an empty one asks for the types."""
    q = question.strip().lower()
    has = lambda *words: all(w in q for w in words)
    either = lambda *words: any(w in q for w in words)
    if has("complex") and either("function", "method"):
        return Plan("R1", patterns.complex_functions)
    if has("interface"):
        part = name_part(q)
        if part:
            return Plan("R2a", lambda g: patterns.interfaces_named(g, part))
        word = next((w for w in INTERFACE_WORDS if w in q), None)
        if word:
            return Plan("R2b", lambda g: patterns.interfaces_named(g, word))
        if has("implement"):
            return Plan("R2c", patterns.implement_pairs)
        return Plan("R2d", patterns.all_interfaces)
    if has("package"):
        return Plan("R3a", patterns.import_pairs) if has("import") else Plan("R3b", patterns.all_packages)
    if has("call"):
        return Plan("R4a", patterns.callers) if either("who calls", "callers") else Plan("R4b", patterns.call_pairs)
    rules: tuple[tuple[str, bool, Callable[[CodeGraph], DataFrame]], ...] = (
        ("R5", has("embed"), patterns.embeds_pairs),
        ("R6", has("error", "handle"), patterns.error_pairs),
        ("R7", either("goroutine", "concurrent"), patterns.spawn_pairs),
        ("R8", has("return", "type"), patterns.returns_pairs),
        ("R9", has("parameter", "type"), patterns.parameter_type_pairs),
        ("R10a", has("method") and either("has", "with"), patterns.methods_per_type),
        ("R10b", has("method"), patterns.methods_by_complexity),
        ("R11", either("construct", "create", "instantiate"), patterns.constructor_pairs),
        ("R12", has("use"), patterns.uses_pairs),
        ("R13", either("connected", "popular"), patterns.most_connected),
        ("R14", has("error"), patterns.error_labels),
    )
    for rule, hit, build in rules:
        if hit:
            return Plan(rule, build)
    return Plan("R15", patterns.type_distribution)


PATTERNS: dict[str, Callable[[CodeGraph], DataFrame]] = {
    "duplicate": patterns.duplicate_functions,
    "usage": patterns.usage,
    "error_handlers": patterns.error_handlers,
    "goroutine_spawners": patterns.goroutine_spawners,
    "type_constructors": patterns.type_constructors,
    "embedded_types": patterns.embedded_types,
    # named in documentation only
    "field": lambda g: g.hop("has_field").groupBy("s_id", "s_label").count(),
    "parameter": patterns.many_parameters,
    "interface": patterns.interface_counts,
    "constructor": patterns.type_constructors,
    "embedding": patterns.embedded_types,
    "orphan": patterns.orphan_nodes,
}
ARCHITECTURE: dict[str, Callable[[CodeGraph], DataFrame]] = {"layers": patterns.layers, "patterns": patterns.factory_pattern, "coupling": patterns.coupling, "dependencies": patterns.import_strength}


def find_patterns(g: CodeGraph, kind: str) -> DataFrame:
    if kind not in PATTERNS:
        raise ValueError(f"unsupported pattern type: {kind}")
    return PATTERNS[kind](g)


def detect_architecture(g: CodeGraph, kind: str) -> DataFrame:
    if kind not in ARCHITECTURE:
        raise ValueError(f"unsupported analysis type: {kind}")
    return ARCHITECTURE[kind](g)


__all__ = ["Plan", "detect_architecture", "find_patterns", "name_part", "route"]
