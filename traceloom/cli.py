"""Command line: run a step, list runs, show traces and records, collect garbage.

    python -m traceloom.cli run script.py [entry] [--store ROOT] [--force] | list ROOT | show TRACE | show --store ROOT [--run RUN]
    | output ROOT RECORD_OR_VALUE | remove ROOT RUN | gc ROOT [--before TIME]

A run with a store recalls what earlier ones made and adds what it makes; --force removes the entry's runs and what only they
hold before. `show --store` shows a run's events, the newest run's if none is named.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def load_entry(script: str, entry: str | None):
    """The step to run: the one named, else `main`, else the one named like the file."""
    path = Path(script)
    spec = importlib.util.spec_from_file_location(path.stem, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[path.stem] = module
    spec.loader.exec_module(module)
    for name in [entry] if entry else ["main", path.stem]:
        if hasattr(module, name):
            return getattr(module, name)
    raise SystemExit(f"{script} has no entry {entry or 'main'}")


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="traceloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("run")
    one.add_argument("script")
    one.add_argument("entry", nargs="?")
    one.add_argument("--trace")
    one.add_argument("--store")
    one.add_argument("--force", action="store_true")
    sub.add_parser("list").add_argument("root")
    show = sub.add_parser("show")
    show.add_argument("trace", nargs="?")
    show.add_argument("--store")
    show.add_argument("--run")
    gone = sub.add_parser("remove")
    gone.add_argument("root")
    gone.add_argument("run")
    out = sub.add_parser("output")
    out.add_argument("root")
    out.add_argument("record")
    gc = sub.add_parser("gc")
    gc.add_argument("root")
    gc.add_argument("--before")
    gc.add_argument("--all", action="store_true", help="also the newest run of each entry")
    args = parser.parse_args(argv)
    if args.command == "run":
        from traceloom.plans.steps import Engine
        from traceloom.sources.traces import LineSink

        sink = LineSink(args.trace) if args.trace else None
        call = load_entry(args.script, args.entry)()
        if not args.store:
            print(Engine().run(call, sink=sink))
            return 0
        from traceloom.plans.history import StoreRecords, run_and_publish
        from traceloom.sources.store import RecordStore

        store = RecordStore(session(), args.store)
        if args.force and store.remove_entry(call.step.identity):
            store.collect()
        print(run_and_publish(store, Engine(store.spark, StoreRecords(store)), call, sink=sink))
        return 0
    spark = session()
    from traceloom.sources.store import RecordStore

    if args.command == "show":
        from traceloom.operators.spans import reduce_spans
        from traceloom.sources.traces import read_trace
        from traceloom.streaming.live import rendered

        if args.store:
            store = RecordStore(spark, args.store)
            run = args.run or store.newest_run()
            if run is None:
                raise SystemExit(f"{args.store} has no run")
            events = store.events(run)
        else:
            events = read_trace(spark, args.trace)
        reduce_spans(events).orderBy("run_id", "seq").select("run_id", "seq", "parent_seq", "name", "status", "start_ts", "end_ts", "error").show(1000, False)
        for row in rendered(events).orderBy("run_id", "ord").toLocalIterator():
            print(row["line"])
    elif args.command == "list":
        from traceloom.functions import formats

        age = formats.age((F.unix_micros(F.current_timestamp()) - F.unix_micros("started_at")) / 1e6)
        RecordStore(spark, args.root).runs().orderBy("entry", F.desc("started_at")).select("run_id", "entry", age.alias("age"), "steps", "is_latest").show(1000, False)
    elif args.command == "output":
        shown = 0
        for row in RecordStore(spark, args.root).sections(args.record).toLocalIterator():
            shown += 1
            print(f"{row['section']} {row['ord']}: {row['text']}")
        return 0 if shown else 1
    elif args.command == "remove":
        return 0 if RecordStore(spark, args.root).remove_run(args.run) else 1
    else:
        store = RecordStore(spark, args.root)
        if args.before:
            print("removed runs:", *store.remove_runs(args.before, keep_latest=not args.all))
        print("removed values:", store.collect().count())
        store.abandon_stale()
    return 0


if __name__ == "__main__":
    sys.exit(main())
