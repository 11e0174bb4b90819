"""Commands: inspect, info, list, scene, export and extract (CMD-01 to CMD-03, CMD-06, ERR-04)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from assetlake.engine import Engine
from assetlake.operators import sinks
from assetlake.operators.hierarchy import outline

#: Exit codes: done; usage or another error; done in part.
DONE, FAILED, PARTIAL = 0, 1, 3


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser("assetlake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("inspect", "info", "list", "scene", "export", "extract"):
        command = commands.add_parser(name)
        command.add_argument("path")
        if name == "list":
            command.add_argument("--offset", type=int, default=0)
            command.add_argument("--limit", type=int, default=100)
        if name in ("export", "extract"):
            command.add_argument("out")
            command.add_argument("--overwrite", action="store_true")
        if name == "export":
            command.add_argument("--mode", choices=("json", "raw", "text", *sinks.MEDIA), default="json")
            command.add_argument("--class-id", type=int, action="append")
    return parser.parse_args(args)


def run(spark: SparkSession, args: list[str], out=sys.stdout) -> int:
    """Print a command's rows; failed files or roots make it partial."""
    a = arguments(args)
    engine = Engine.open(spark, a.path)
    if a.command in ("export", "extract"):
        done = engine.export(a.out, a.mode, a.class_id, a.overwrite) if a.command == "export" else engine.extract(a.out, a.overwrite)
        rows = sinks.report(done).orderBy("outcome").collect()
        for r in rows:
            print(f"{r['outcome']}\t{r['files']}\t{r['bytes']}", file=out)
        failed = any(r["outcome"] == "failed" for r in rows)
    else:
        table = {"inspect": engine.inspect, "info": engine.info, "scene": lambda: outline(engine.scene()), "list": lambda: engine.list(a.offset, a.limit)}[a.command]()
        for r in table.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in r), file=out)
        failed = False
    return PARTIAL if failed or not engine.catalog.diagnostics.isEmpty() else DONE


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("assetlake").getOrCreate(), sys.argv[1:]))
