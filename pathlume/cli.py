"""Command line: ``python -m pathlume.cli --catalog FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from pathlume.api import Lume
from pathlume.operators.aggregations import DEFAULT_TOP
from pathlume.operators.sequences import DEFAULT_HEAVY_ROWS
from pathlume.operators.table_profile import CATEGORICAL_RATIO, LEAST_TOP_SHARE, TOP_VALUES
from pathlume.server import serve
from pathlume.sources.catalog import SAMPLE_MOST, SAMPLE_SHARE, UNREGISTER_AFTER_S, ValidationMode
from pathlume.sources.storage import DEFAULT_PATTERN

CONFIG = {
    "aggregations.top.default": DEFAULT_TOP,
    "dataset.categorical.ratio": CATEGORICAL_RATIO,
    "dataset.categorical.top.count": TOP_VALUES,
    "dataset.categorical.top.least.share": LEAST_TOP_SHARE,
    "registration.sample.share": SAMPLE_SHARE,
    "registration.sample.most": SAMPLE_MOST,
    "unregister.after.seconds": UNREGISTER_AFTER_S,
    "sequence.heavy.rows": DEFAULT_HEAVY_ROWS,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathlume")
    p.add_argument("--catalog", default="./catalog", help="folder of the registered datasets")
    p.add_argument("--master", default=None)
    commands = p.add_subparsers(dest="command", required=True)
    register = commands.add_parser("register", help="register a dataset")
    for name in ("name", "basepath", "group_id_column", "timestamp_column"):
        register.add_argument(name)
    register.add_argument("--pattern", default=DEFAULT_PATTERN)
    register.add_argument("--validation", choices=[m.value for m in ValidationMode], default=ValidationMode.SAMPLE.value)
    register.add_argument("--skip-uniques", action="store_true")
    commands.add_parser("list", help="list datasets")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name")
    how = run.add_mutually_exclusive_group(required=True)
    how.add_argument("--file")
    how.add_argument("--string")
    how.add_argument("--empty", action="store_true")
    info = commands.add_parser("info", help="show a dataset's schema")
    info.add_argument("name")
    info.add_argument("--full", action="store_true")
    gone = commands.add_parser("unregister", help="forget a dataset")
    gone.add_argument("name")
    gone.add_argument("--force", action="store_true")
    commands.add_parser("config", help="show the settings that affect results")
    server = commands.add_parser("serve", help="answer HTTP requests")
    server.add_argument("--port", type=int, default=5000)
    return p


def perform(lume: Lume, args: argparse.Namespace) -> object:
    if args.command == "register":
        return lume.register_dataset(args.name, args.basepath, args.group_id_column, args.timestamp_column, pattern=args.pattern, mode=ValidationMode(args.validation), validate_uniques=not args.skip_uniques)
    if args.command == "list":
        return lume.list_datasets()
    if args.command == "run":
        query = {} if args.empty else json.loads(Path(args.file).read_text() if args.file else args.string)
        return lume.run_query(args.name, query)
    if args.command == "info":
        return lume.get_dataset_schema(args.name, args.full) or {"success": False, "errorMessage": f"there is no dataset {args.name}"}
    return lume.unregister_dataset(args.name, args.force)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config":
        print(json.dumps(CONFIG, indent=2))
        return 0
    if spark is None:
        builder = SparkSession.builder.appName("pathlume")
        spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    lume = Lume(spark, args.catalog)
    if args.command == "serve":
        serve(lume, port=args.port).serve_forever()
        return 0
    try:
        found = perform(lume, args)
    except (ValueError, OSError) as e:
        found = {"success": False, "errorMessage": str(e)}
    print(json.dumps(found, indent=2))
    return 0 if not isinstance(found, dict) or found.get("success", True) else 1


if __name__ == "__main__":
    sys.exit(main())
