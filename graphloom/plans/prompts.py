"""Guided analyses: named lists of steps, each a tool or a graph operator with its arguments, and the template language.

Steps hold no query texts. ``Prompt.render`` writes them as instructions, ``run`` carries them out over a graph.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators import impact, paths, patterns
from graphloom.plans.router import detect_architecture, find_patterns, route

_TAG = re.compile(r"\{\{[^{}]*\}\}")


def render(template: str, values: dict[str, str]) -> str:
    """``{{k}}``, ``{{#if k}}..{{/if}}`` and ``{{#unless k}}..{{/unless}}`` for the keys given.

    Only keys that are present are processed: the block of an absent key keeps its body and loses its tags.
    """
    text = template
    for key, value in values.items():
        pattern = re.compile(r"\{\{#(if|unless) " + re.escape(key) + r"\}\}(.*?)\{\{/\1\}\}", re.S)
        text = pattern.sub(lambda m, v=value: m.group(2) if bool(v) == (m.group(1) == "if") else "", text)
        text = text.replace("{{" + key + "}}", str(value))
    return _TAG.sub("", text)


# ---- operators that steps name


def within_packages(df: DataFrame, package: str | None, column: str = "package") -> DataFrame:
    """Rows whose package is or lies below ``package``; all without one."""
    if not package or column not in df.columns:
        return df
    return df.where((F.col(column) == package) | F.col(column).startswith(package.rstrip("/") + "/") | F.col(column).contains("/" + package))


def imports_of(g: CodeGraph, package: str, include_external: bool = False) -> DataFrame:
    found = impact.forward_imports(g, package)
    return found if include_external else found.where(~patterns.external(F.col("imports")))


def implemented_interfaces(g: CodeGraph, limit: int) -> DataFrame:
    counts = patterns.interface_counts(g).where(F.col("implementations") > 0)
    return counts.orderBy(F.desc("implementations"), "id").limit(limit)


def entry_reach(g: CodeGraph, entries: str, sinks: str, most: int, limit: int) -> DataFrame:
    """Call paths from functions named like an entry point to those named like a sensitive call; comma-separated parts."""
    named = lambda parts: F.lower(F.col("label")).rlike("|".join(re.escape(p.strip().lower()) for p in parts.split(",") if p.strip()) or "(?!)")
    return paths.reachable(g, named(entries), named(sinks), most, limit)


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        patterns.complex_functions, patterns.unused_private, patterns.god_objects, patterns.many_parameters, patterns.hot_functions, patterns.interface_counts, impact.component_callers, impact.interface_impact,
        impact.type_dependents, impact.reverse_imports, impact.interface_takers, impact.interface_returners, impact.test_callers, impact.public_functions, paths.path_nodes, paths.path_goroutines, paths.on_cycles,
        imports_of, implemented_interfaces, entry_reach,
    )
}


@dataclass(frozen=True)
class Step:
    """``call`` is a tool, or one of OPERATORS; string arguments are templates. ``only_if`` names the argument it needs,
    ``areas`` the focus areas it belongs to (all without any)."""

    call: str
    why: str
    arguments: dict[str, Any]
    only_if: str | None = None
    areas: tuple[str, ...] = ()

    def shown(self) -> str:
        return f"{self.why}: {self.call}({', '.join(f'{k}={v}' for k, v in self.arguments.items())})"


def step(call: str, why: str, only_if: str | None = None, areas: tuple[str, ...] = (), **arguments: Any) -> Step:
    return Step(call, why, arguments, only_if, areas)


def ask(question: str, why: str, only_if: str | None = None) -> Step:
    return Step("natural_query", why, {"question": question}, only_if)


@dataclass(frozen=True)
class Prompt:
    name: str
    about: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    steps: tuple[Step, ...]

    def _check(self, values: dict[str, str]) -> None:
        missing = [a for a in self.required if not values.get(a)]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")

    def chosen(self, values: dict[str, str]) -> list[Step]:
        """The steps for these arguments: those of the focus area where steps know it, and none whose argument is absent."""
        area = (values.get("focus_area") or "").strip().lower()
        known = any(area in s.areas for s in self.steps)
        return [s for s in self.steps if (not s.only_if or values.get(s.only_if)) and (not known or not s.areas or area in s.areas)]

    def template(self, values: dict[str, str]) -> str:
        where = " in workspace {{workspace}}" if "workspace" in self.required else ""
        return "\n".join([f"Goal: {self.about}{where}.", "", *[f"{i}. {s.shown()}" for i, s in enumerate(self.chosen(values), 1)]])

    def render(self, **values: str) -> str:
        self._check(values)
        return render(self.template(values), values)

    def run(self, g: CodeGraph, **values: str) -> Iterator[tuple[str, DataFrame]]:
        """(why, rows) of every step over a graph; a step that loads a workspace has been done by whoever gave the graph."""
        self._check(values)
        package = values.get("package_filter") or values.get("component")
        for s in self.chosen(values):
            filled = {k: render(v, values) if isinstance(v, str) else v for k, v in s.arguments.items()}
            if s.call == "analyze_workspace":
                continue
            if s.call in OPERATORS:
                df = OPERATORS[s.call](g, **{k: v.lower() in ("true", "yes", "1") if k == "include_external" else v for k, v in filled.items()})
            elif s.call == "natural_query":
                df = route(filled["question"]).run(g)
            elif s.call == "find_patterns":
                df = find_patterns(g, filled["patternType"])
            elif s.call == "detect_architecture":
                df = detect_architecture(g, filled["analysisType"])
            elif s.call == "find_implementers":
                df = impact.find_implementers(g, filled["interfaceName"])
            elif s.call == "trace_call_path":
                df = paths.trace_call_path(g, filled["from"], filled["to"])
            else:
                df = impact.analyze_impact(g, filled["nodeId"], filled["changeType"])
            yield s.why, within_packages(df, package)


#: fixed values: the names of the fifteen analyses, of their arguments, and their thresholds and limits
CATALOGUE = (
    Prompt("analyze_new_codebase", "load a codebase and see how it is built", ("workspace_path",), ("workspace_name", "include_external"), (
        step("analyze_workspace", "load it", workspacePath="{{workspace_path}}", workspaceName="{{workspace_name}}"), step("detect_architecture", "see its layers", analysisType="layers"),
        ask("show all interfaces", "list its interfaces"), step("find_patterns", "look for duplicates", patternType="duplicate"), ask("which functions are most complex", "find what is complex"),
        step("imports_of", "see what it imports", only_if="include_external", package="/", include_external="{{include_external}}"),
    )),
    Prompt("assess_code_quality", "find code that is hard to keep", ("workspace",), ("focus_area",), (
        step("complex_functions", "complex functions", areas=("complexity",), above=10, limit=None), step("find_patterns", "duplicates", areas=("duplication", "duplicates"), patternType="duplicate"),
        step("unused_private", "private code that nothing uses", areas=("dead code", "unused")), step("god_objects", "structs with many members", areas=("coupling", "structure", "complexity")),
        step("many_parameters", "long parameter lists", areas=("coupling", "structure", "complexity")), ask("{{focus_area}}", "what matters here", "focus_area"),
    )),
    Prompt("understand_architecture", "see how the parts depend on each other", ("workspace",), ("component",), (
        step("detect_architecture", "layers", analysisType="layers"), ask("which packages import which", "imports"), step("interface_counts", "interfaces by implementations"),
        step("component_callers", "who calls the component", only_if="component", name="{{component}}"),
    )),
    Prompt("analyze_change_impact", "see what a change breaks", ("workspace", "component_name", "change_type"), (), (
        step("analyze_impact", "direct impact", nodeId="{{component_name}}", changeType="{{change_type}}"), step("component_callers", "callers", name="{{component_name}}"),
        step("interface_impact", "interface impact", name="{{component_name}}"), ask("who calls {{component_name}}", "callers in words"), step("type_dependents", "dependents of a type", name="{{component_name}}"),
    )),
    Prompt("debug_execution_flow", "follow calls from one point to another", ("workspace", "entry_point", "target_point"), (), (
        Step("trace_call_path", "the path", {"from": "{{entry_point}}", "to": "{{target_point}}"}), step("path_nodes", "what lies on it", start="{{entry_point}}", end="{{target_point}}"),
        ask("which functions handle errors", "error handling"), step("path_goroutines", "goroutines on it", start="{{entry_point}}", end="{{target_point}}"), ask("who calls {{target_point}}", "other ways to the target"),
    )),
    Prompt("analyze_interface_usage", "see who implements, takes and returns an interface", ("workspace", "interface_name"), (), (
        step("find_implementers", "implementers", interfaceName="{{interface_name}}"), step("interface_takers", "takers", name="{{interface_name}}"), step("interface_returners", "returners", name="{{interface_name}}"),
    )),
    Prompt("plan_refactoring", "prepare a refactoring", ("workspace", "target", "goal"), (), (
        ask("who calls {{target}}", "callers"), step("analyze_impact", "impact", nodeId="{{target}}", changeType="modify"), ask("interfaces named {{target}}", "interfaces"),
        step("test_callers", "tests that call it", name="{{target}}"), ask("which functions are complex for {{goal}}", "complexity"),
    )),
    Prompt("find_code_patterns", "find a pattern of code", ("workspace", "pattern"), ("package_filter",), (step("find_patterns", "the pattern", patternType="{{pattern}}"), ask("functions with {{pattern}}", "in words"))),
    Prompt("analyze_dependencies", "see the imports of a package", ("workspace", "source_package"), ("include_external",), (
        step("imports_of", "what it imports", package="{{source_package}}", include_external="{{include_external}}"), step("reverse_imports", "who imports it", package="{{source_package}}"), ask("which packages import which", "all imports"),
    )),
    Prompt("find_performance_issues", "find what may run slow", ("workspace",), ("focus_area",), (
        step("complex_functions", "complex functions", areas=("complexity", "cpu"), above=15, limit=20), step("hot_functions", "hot functions", areas=("calls", "cpu", "hotspots")), step("on_cycles", "recursion", areas=("recursion", "calls")),
    )),
    Prompt("analyze_test_coverage", "see what tests reach", ("workspace", "package"), (), (
        step("public_functions", "public functions", package="{{package}}"), step("test_callers", "tested functions", package="{{package}}"), ask("which functions are complex", "complexity"),
    )),
    Prompt("plan_api_migration", "move callers from one API to another", ("workspace", "old_api", "new_api"), (), (
        ask("who calls {{old_api}}", "callers"), step("analyze_impact", "what breaks", nodeId="{{old_api}}", changeType="delete"), ask("who calls {{new_api}}", "users of the new one"),
    )),
    Prompt("prepare_code_review", "prepare a review", ("workspace", "changed_components"), (), (
        ask("who calls {{changed_components}}", "callers"), step("analyze_impact", "impact", nodeId="{{changed_components}}", changeType="modify"), ask("which functions handle errors", "error handling"),
    )),
    Prompt("onboard_new_developer", "give a first overview", ("workspace",), ("focus_area",), (
        ask("show the most connected nodes", "hubs"), step("implemented_interfaces", "interfaces in use", limit=10), step("detect_architecture", "layers", analysisType="layers"), ask("{{focus_area}}", "what the newcomer works on", "focus_area"),
    )),
    Prompt("security_analysis", "see which sensitive code entry points reach", ("workspace", "entry_points"), (), (
        ask("functions named {{entry_points}}", "entry points"), step("entry_reach", "paths to sensitive calls", entries="handler,{{entry_points}}", sinks="exec,query", most=5, limit=20), ask("which functions handle errors", "error handling"),
    )),
)
PROMPTS = {p.name: p for p in CATALOGUE}
