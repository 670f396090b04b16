"""python -m tesserae query|describe|dump|optimize|serve --data DIR ...: one database from the command line."""

from __future__ import annotations

import argparse
import sys

from tesserae.session import session
from tesserae.sources.catalog import Catalog
from tesserae.sources.formats import FORMATS, render


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    parser.add_argument("--data", required=True, help="the database folder")
    parser.add_argument("--master", help="Spark master; by default what spark-submit or the environment says")
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="run a statement")
    query.add_argument("text")
    query.add_argument("--format", default=FORMATS[0], choices=FORMATS)
    describe = commands.add_parser("describe", help="parts of a table as JSON: identity, rows, bytes, bounds")
    describe.add_argument("table")
    describe.add_argument("--part")
    commands.add_parser("optimize", help="merge parts of all tables")
    serve = commands.add_parser("serve", help="answer statements over HTTP")
    serve.add_argument("--port", type=int, default=8123)
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--merge-every", type=float, default=5.0, help="seconds between merge steps; 0 for none")
    dump = commands.add_parser("dump", help="column chunks of one part as JSON: codec, encodings, bytes, bounds")
    dump.add_argument("table")
    dump.add_argument("part")
    asked = parser.parse_args(argv)
    catalog = Catalog(session(asked.master), asked.data)
    if asked.command == "serve":
        from tesserae.sources.background import Compactor
        from tesserae.sources.server import serve as start

        if asked.merge_every > 0:
            Compactor(catalog, asked.merge_every).start()
        start(catalog, asked.port, asked.host).serve_forever()
    elif asked.command == "optimize":
        print(catalog.optimize_all())
    else:
        if asked.command == "query":
            frame, kinds = catalog.execute(asked.text)
        else:
            frame, kinds = (catalog.describe if asked.command == "describe" else catalog.dump)(asked.table, asked.part), {}
        for piece in render(frame, kinds, asked.format if asked.command == "query" else "JSON"):
            sys.stdout.write(piece)
    return 0


if __name__ == "__main__":
    sys.exit(main())
