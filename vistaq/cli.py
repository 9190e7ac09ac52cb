"""Command line: add, update or delete folders of one store."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from .plans.engine import Engine


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vistaq")
    parser.add_argument("--encoder", default="vistaq.functions.encoders:LetterEncoder", help="module:class of the encoder")
    parser.add_argument("--store", required=True, help="folder of the stores, one below it for each model")
    parser.add_argument("--add", nargs="+", metavar="FOLDER")
    parser.add_argument("--update", action="store_true")
    parser.add_argument("--delete", metavar="FOLDER")
    parser.add_argument("--batch", type=int, default=96)
    given = parser.parse_args(args)
    module, _, name = given.encoder.partition(":")
    encoder = getattr(importlib.import_module(module), name)()
    spark = SparkSession.builder.appName("vistaq").getOrCreate()
    engine = Engine(spark, given.store, encoder)
    tell = lambda status, **values: print(status, values)
    if given.add:
        out = engine.add(given.add, batch=given.batch, report=tell)
    elif given.update:
        out = engine.update(batch=given.batch, report=tell)
    elif given.delete:
        print("deleted" if engine.delete(given.delete) else "not found")
        return 0
    else:
        parser.print_help()
        return 2
    print(f"{out.embedded} embedded, {out.failed} failed, {out.deleted} deleted in {out.seconds:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
