"""Command line: map, context, query, evidence, stats, clear."""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from . import __version__
from .errors import SiltstoneError
from .sources.snapshot import resolve_cache_dir


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description="Ranked, budgeted context of a source repository.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, budget: int | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        c.add_argument("--repo", default=".")
        if budget is not None:
            c.add_argument("--budget", type=int, default=budget)
            c.add_argument("--format", choices=("markdown", "json"), default="markdown")
            c.add_argument("--language", action="append")
        return c

    command("map", "files by structural importance", 2048)
    command("context", "context around files", 4096).add_argument("files", nargs="+")
    command("query", "context for a question", 4096).add_argument("text")
    e = command("evidence", "structured evidence as JSON")
    e.add_argument("--text")
    e.add_argument("--file", action="append")
    for name, default in (("--limit", 8), ("--symbols", 5), ("--neighbors", 3)):
        e.add_argument(name, type=int, default=default)
    command("stats", "counts of the index")
    command("clear", "remove the snapshot")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code 0, or 1 with a message on the standard error stream."""
    args = _parser().parse_args(argv)
    try:
        if args.command == "clear":
            shutil.rmtree(resolve_cache_dir(args.repo), ignore_errors=True)
            print("cleared")
            return 0
        if args.command == "evidence" and bool(args.text) == bool(args.file):
            raise SiltstoneError("evidence needs either --text or --file")
        from .plans.engine import Engine

        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("siltstone").config("spark.ui.enabled", "false").getOrCreate()
        engine = Engine(spark, args.repo, languages=getattr(args, "language", None))
        if args.command == "map":
            print(engine.repo_map(args.budget, args.format))
        elif args.command == "context":
            print(engine.context_for(args.files, args.budget, args.format))
        elif args.command == "query":
            print(engine.query(args.text, args.budget, args.format))
        elif args.command == "evidence":
            limits = args.limit, args.symbols, args.neighbors
            print(json.dumps(engine.evidence_for_query(args.text, *limits) if args.text else engine.evidence_for_files(args.file, *limits), indent=2))
        else:
            print(json.dumps(engine.stats, indent=2))
    except (SiltstoneError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
