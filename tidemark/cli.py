"""Command line over Store: open, put, get, delete, scan, stats, property, doctor."""

from __future__ import annotations

import argparse
import json
import sys

from tidemark.model import InvalidConfig, StoreError


class InvalidArguments(StoreError):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise InvalidArguments(message)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="tidemark", add_help=True)
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    flags = {"open": (), "put": ("key", "value"), "get": ("key",), "delete": ("key",), "scan": (), "stats": (), "property": ("name",), "doctor": ()}
    for name, needed in flags.items():
        command = commands.add_parser(name)
        command.add_argument("--path", required=True)
        command.add_argument("--json", action="store_true")
        for flag in needed:
            command.add_argument(f"--{flag}", required=True)
        if name == "scan":
            for flag in ("prefix", "start", "end"):
                command.add_argument(f"--{flag}")
    return top


def check_scan(args) -> None:
    if args.prefix is not None and (args.start is not None or args.end is not None):
        raise InvalidArguments("--prefix excludes --start and --end")
    if args.end is not None and args.start is None:
        raise InvalidArguments("--end needs --start")
    if args.start is not None and args.end is not None and args.start.encode() > args.end.encode():
        raise InvalidArguments("--start is after --end")


def run(args, spark) -> str:
    """What a command prints."""
    from tidemark.sources.store import Store

    if args.command == "scan":
        check_scan(args)
    store = Store.open(spark, args.path)
    compact = {"separators": (",", ":"), "ensure_ascii": False}
    try:
        if args.command == "open":
            return json.dumps({"ok": True}, **compact) if args.json else "open ok"
        if args.command in ("put", "delete"):
            store.write_batch([(args.command, args.key, getattr(args, "value", None))])
            return json.dumps({"ok": True, "op": args.command}, **compact) if args.json else "ok"
        if args.command == "get":
            value = store.get(args.key)
            return json.dumps({"key": args.key, "value": value}, **compact) if args.json else value
        if args.command == "scan":
            rows = store.scan_prefix(args.prefix) if args.prefix is not None else store.scan(args.start, args.end)
            lines = (json.dumps({"key": r.k, "value": r.v}, **compact) if args.json else f"{r.k}\t{r.v}" for r in rows.toLocalIterator())
            return "[" + ",".join(lines) + "]" if args.json else "\n".join(lines)
        if args.command == "stats":
            found = store.stats()
            shown = {"keys": found["memory_keys"], "live_keys": found["keys"], "next_sequence": found["next_sequence"], "wal_size_bytes": found["wal_size_bytes"]}
            return json.dumps(shown, **compact) if args.json else "\n".join(f"{k}={v}" for k, v in shown.items())
        if args.command == "property":
            value = store.property(args.name)
            return json.dumps({"name": args.name, "value": value}, **compact) if args.json else str(value)
        broken = {k: v for k, v in store.doctor().items() if v and k != "rows"}
        if broken:
            raise InvalidConfig(f"doctor found {broken}")
        return json.dumps({"ok": True}, **compact) if args.json else "doctor ok"
    finally:
        store.close()


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        args = parser().parse_args(argv)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.getOrCreate()
        print(run(args, spark))
        return 0
    except StoreError as why:
        name = type(why).__name__
        print(json.dumps({"ok": False, "error": name}) if "--json" in argv else f"error: {name}: {why}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
