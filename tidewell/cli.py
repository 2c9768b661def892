"""Command line: `query` runs SQL or prints schemas, `serve` starts the HTTP service."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from tidewell.plans.pipeline import Engine, load_all
from tidewell.session import session
from tidewell.sources import context

ENV, HOME = "TIDEWELL_CONTEXT", "~/.tidewell/context.yaml"


def context_path(flag: str | None) -> str | None:
    """The flag, the environment variable or the file at home. One that is named must exist; that at home may not."""
    named = flag or os.environ.get(ENV)
    if named:
        if not os.path.exists(named):
            raise SystemExit(f"no context file {named}")
        return named
    home = os.path.expanduser(HOME)
    return home if os.path.exists(home) else None


def table_text(df: DataFrame) -> str:
    rows = [["" if v is None else str(v) for v in r] for r in df.collect()]
    out = []
    if rows:
        widths = [max(len(c), *(len(r[i]) for r in rows)) for i, c in enumerate(df.columns)]
        line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        show = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|"
        out = [line, show(df.columns), line, *map(show, rows), line]
    return "\n".join([*out, f"{len(rows)} row(s) returned"])


def schema_text(engine: Engine, tables: list[str]) -> str:
    return "\n".join("\n".join([f"table: {t}", *(f"  {f.name}: {f.dataType.simpleString()}" for f in engine.spark.table(t).schema)]) for t in tables)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell")
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query")
    query.add_argument("--sql", "-e")
    query.add_argument("--file", "-f", help="wins over --sql")
    query.add_argument("--ctx")
    query.add_argument("--schema", action="store_true")
    which = query.add_mutually_exclusive_group()
    which.add_argument("--all", action="store_true")
    which.add_argument("-t", "--table")
    serve = commands.add_parser("serve")
    serve.add_argument("--ctx")
    serve.add_argument("--pipelines", required=True)
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    for p in (query, serve):
        p.add_argument("--master", default=os.environ.get("SPARK_MASTER", "local[*]"))
    o = parser.parse_args(args)

    path = context_path(o.ctx)
    if o.command == "query" and o.schema and not (o.all or o.table):
        parser.error("--schema needs --all or -t")
    if o.command == "query" and not o.schema and not (o.sql or o.file):
        parser.error("--sql or --file is required")
    engine = Engine(session(o.master), context.load(path) if path else [])
    if o.command == "serve":
        from tidewell.server import Service, server

        server(Service(engine, load_all(o.pipelines)), o.host, o.port).serve_forever()
    elif o.schema:
        print(schema_text(engine, [s.name for s in engine.sources] if o.all else [o.table]))
    else:
        print(table_text(engine.sql(Path(o.file).read_text() if o.file else o.sql)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
