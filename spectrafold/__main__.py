"""``python -m spectrafold convert|info|read``: the engine on the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spectrafold", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="convert files to containers")
    convert.add_argument("-i", "--input", nargs="+", required=True)
    convert.add_argument("-o", "--output", required=True, help="folder of the containers")
    convert.add_argument("-m", "--mode", default="binary", choices=("binary", "json", "yaml"))
    convert.add_argument("-p", "--precision", type=float, default=0.001)
    convert.add_argument("--keep-zero", action="store_true", help="keep peaks without intensity")
    info = commands.add_parser("info", help="header and number of entries of a container")
    info.add_argument("file")
    read = commands.add_parser("read", help="entries of a container as lines of JSON")
    read.add_argument("file")
    read.add_argument("-e", "--entry", type=int, help="one entry")
    read.add_argument("-c", "--columns", nargs="+")
    return top


def main(arguments: list[str] | None = None) -> int:
    """Runs one command; 1 where a file failed to convert."""
    a = parser().parse_args(arguments)
    if a.command == "info":
        print(json.dumps({"entries": api.get_entry_number(a.file), **api.get_basic_info(a.file)}))
        return 0
    spark = SparkSession.builder.appName("spectrafold").getOrCreate()
    if a.command == "convert":
        done = api.convert_files(spark, a.input, a.output, a.mode, a.precision, not a.keep_zero).collect()
        for r in done:
            print(json.dumps(r.asDict()))
        return int(any(r["status"] != "ok" for r in done))
    rows = api.parse_omg_file(spark, a.file, columns=a.columns) if a.entry is None else api.get_entry(spark, a.file, a.entry)
    for line in rows.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
