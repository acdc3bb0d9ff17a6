"""The command line: python -m sparkseek COMMAND ...

    check FILE | tree FILE | compile FILE      without Spark
    exec STATEMENTS | run FILE | explain FILE  on tables (--table name=path:id, --vector table.column:size) and on
                                               the collections of --path
    dump COLLECTION FILE                       a collection of --path as a script
    convert [FILE]                             REST requests as statements (JSON of a file or of the standard input)
    version
"""

from __future__ import annotations

import argparse
import json
import sys

from sparkseek.errors import SeekError


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkseek", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("check", "tree", "compile"):
        commands.add_parser(name).add_argument("file")
    for name in ("exec", "run", "explain"):
        c = commands.add_parser(name)
        c.add_argument("statements" if name == "exec" else "file")
        c.add_argument("--table", action="append", default=[], help="name=path:id column")
        c.add_argument("--vector", action="append", default=[], help="table.column:size")
        c.add_argument("--path", help="where collections are kept")
        c.add_argument("--on-error", choices=("stop", "continue"), default="stop")
        c.add_argument("--json", action="store_true")
    c = commands.add_parser("dump")
    c.add_argument("collection")
    c.add_argument("output")
    c.add_argument("--path", required=True)
    c.add_argument("--batch-size", type=int, default=100)
    c = commands.add_parser("convert")
    c.add_argument("file", nargs="?", default="-")
    c.add_argument("--collection", default="unknown")
    commands.add_parser("version")
    return p


def _text(file: str) -> str:
    if file == "-":
        return sys.stdin.read()
    with open(file, encoding="utf-8") as f:
        return f.read()


def _engine(a: argparse.Namespace):
    from pyspark.sql import SparkSession

    from sparkseek.engine import Engine
    from sparkseek.sources.catalog import VectorDef

    engine = Engine(SparkSession.builder.getOrCreate(), path=a.path)
    vectors: dict[str, dict[str, VectorDef]] = {}
    for v in getattr(a, "vector", ()):
        table, rest = v.split(".", 1)
        column, size = rest.rsplit(":", 1)
        vectors.setdefault(table, {})[column] = VectorDef(size=int(size))
    for t in getattr(a, "table", ()):
        name, rest = t.split("=", 1)
        path, column = rest.rsplit(":", 1)
        engine.register(name, engine.spark.read.parquet(path), column, vectors.get(name))
    return engine


def _work(a: argparse.Namespace) -> int:
    if a.command == "version":
        from sparkseek import __version__

        print(__version__)
    elif a.command == "check":
        from sparkseek.parser import parse

        print(f"{len(parse(_text(a.file)))} statements")
    elif a.command in ("tree", "compile"):
        from sparkseek.parser import parse
        from sparkseek.client import Stmt, compile_query

        made = [Stmt(s).to_dict() if a.command == "tree" else compile_query(Stmt(s)) for s in parse(_text(a.file))]
        print(json.dumps(made, indent=1, default=str))
    elif a.command == "convert":
        from sparkseek.sources.convert import convert_request

        for statement in convert_request(json.loads(_text(a.file)), a.collection):
            print(f"{statement};")
    elif a.command == "dump":
        from sparkseek.sources.dump import dump

        print(f"{dump(_engine(a).collection(a.collection), a.output, a.batch_size)} statements")
    elif a.command == "explain":
        print(_engine(a).explain(_text(a.file)))
    else:
        from sparkseek.client import answer

        report = _engine(a).execute(a.statements if a.command == "exec" else _text(a.file), a.on_error)
        if a.json:
            print(json.dumps(answer(report), indent=1, default=str))
        else:
            for r in report.results:
                print(f"{r.statement}: {'ok' if r.ok else r.error}")
                if r.data is not None:
                    r.data.show(50, truncate=80)
        return 0 if report.ok else 1
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return _work(_arguments().parse_args(argv))
    except SeekError as e:
        print(e, e.span or "", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
