"""Command line: index, status, recall, callers, impact, watch, version; 0 if answered, 1 on failure, 2 on bad usage."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import __version__


def watch(spark, store: str, root: str, events: str | None, **trigger) -> int:
    """Keep the stored graph of ``root`` current until interrupted (or, with availableNow, until nothing is left), from event files or by watching the folder."""
    from .sources.store import Store
    from .streaming.maintain import EVENTS, Maintainer
    from .streaming.watch import folder_events

    keeper = Maintainer(spark, Store(spark, store), root, absolute=True)
    stream = spark.readStream.schema(EVENTS).json(events) if events else folder_events(spark, root)
    query = keeper.start(stream, f"{store}/watch-{os.path.basename(root) or 'root'}", **trigger)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        keeper.stop()
    for update in keeper.updates:
        print(update)
    for batch, why in keeper.failures:
        print(f"batch {batch}: {why}", file=sys.stderr)
    return int(bool(keeper.failures))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph")
    parser.add_argument("--store", default=os.environ.get("LOOMGRAPH_STORE", os.path.expanduser("~/.loomgraph")))
    parser.add_argument("command", choices=["index", "status", "recall", "callers", "impact", "watch", "version"])
    parser.add_argument("value", nargs="?", help="path of index, status and watch; query or symbol of the others")
    parser.add_argument("--options", type=json.loads, default={}, help="further arguments as a JSON object")
    parser.add_argument("--events", help="watch: folder of JSON lines (event_seq, path, kind, content) that an editor or agent writes")
    parser.add_argument("--folder", action="store_true", help="watch: look for changes in the folder itself")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "watch" and bool(args.events) == args.folder:
        parser.error("watch needs --events or --folder")
    key = {"index": "path", "status": "path", "recall": "query"}.get(args.command, "symbol")
    given = ({key: args.value} if args.value is not None else {}) | args.options

    from pyspark.sql import SparkSession

    from .service import Workspace

    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if args.command == "watch":
        return watch(spark, args.store, os.path.abspath(args.value or "."), args.events, **args.options)
    space = Workspace(spark, args.store, os.path.join(args.store, "requests.jsonl") if "://" not in args.store else None)
    answer = space.status(**given) if args.command == "status" else space.request(args.command, given)
    print(answer.text, file=sys.stderr if answer.is_error else sys.stdout)
    return int(answer.is_error)


if __name__ == "__main__":
    sys.exit(main())
