"""Command line: ``analyze`` a source folder, ``import`` or ``serve`` a graph document, ``query`` a stored graph."""

from __future__ import annotations

import argparse
import sys

from graphloom.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="source folder to a graph document")
    a.add_argument("--repo", required=True)
    a.add_argument("--output", default="graph.json")
    a.add_argument("--format", default="json", choices=["json"])
    a.add_argument("--summary", action="store_true")
    a.add_argument("--include-packages", default="")
    i = sub.add_parser("import", help="graph document to a store")
    i.add_argument("--input", required=True)
    i.add_argument("--store", required=True)
    i.add_argument("--workspace", required=True)
    q = sub.add_parser("query", help="a tool over a store")
    q.add_argument("--store", required=True)
    q.add_argument("tool")
    q.add_argument("arguments", nargs="*", help="name=value")
    v = sub.add_parser("serve", help="a graph document over HTTP")
    v.add_argument("--graph", default="graph.json")
    v.add_argument("--port", type=int, default=8080)
    args = p.parse_args(argv)
    if args.command == "serve":
        from graphloom.sources.http_view import make_server

        make_server(args.graph, args.port).serve_forever()
        return 0
    spark = local_session()
    from graphloom.graph import CodeGraph
    from graphloom.plans.tools import Tools
    from graphloom.sources.go_extract import analyze_codebase
    from graphloom.sources.graph_json import read_graph_json, write_graph_json, write_summary
    from graphloom.sources.store import GraphStore

    if args.command == "analyze":
        g = analyze_codebase(spark, args.repo, [x for x in args.include_packages.split(",") if x])
        write_graph_json(g, args.output)
        if args.summary:
            write_summary(g, args.output)
    elif args.command == "import":
        nodes, edges = read_graph_json(spark, args.input)
        from pyspark.sql import functions as F

        g = CodeGraph.from_tables(nodes.withColumn("workspace", F.lit(args.workspace)), edges.withColumn("workspace", F.lit(args.workspace)))
        print(GraphStore(spark, args.store).save(g, args.workspace, path=args.input))
    else:
        result = Tools(spark, GraphStore(spark, args.store)).run(args.tool, **dict(x.split("=", 1) for x in args.arguments))
        print(result.text)
        print(result.json())
        return int(result.error)
    return 0


if __name__ == "__main__":
    sys.exit(main())
