"""A prompt for statements: python -m millrace.cli --root FOLDER [--parquet FOLDER]."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
from typing import TextIO

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from millrace.errors import QueryError
from millrace.session import Engine


def statements(lines: TextIO, prompt: bool = False):
    """Texts that end in a semicolon, or at an empty line."""
    held: list[str] = []
    while True:
        if prompt:
            print("... " if held else "millrace> ", end="", flush=True)
        line = lines.readline()
        text = line.strip()
        if text:
            held.append(text)
        if held and (text.endswith(";") or not text):
            yield " ".join(held)
            held = []
        if not line:
            return


def repl(engine: Engine, lines: TextIO, prompt: bool = False) -> None:
    for text in statements(lines, prompt):
        began = time.time()
        try:
            if not engine.run(text):
                return
        except QueryError as error:
            print(f"error: {error}", file=engine.out)
            continue
        except (PySparkException, Py4JError) as error:  # what only shows when the query runs
            print(f"error: {str(error).strip().splitlines()[0]}", file=engine.out)
            continue
        print(f"{time.time() - began:.2f} s", file=engine.out)


def main(arguments: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--root", help="folder of the catalog and its tables")
    options.add_argument("--parquet", help="folder of Parquet tables to register")
    options.add_argument("--joins", choices=["sizes", "collected", "standard", "written"], default="sizes", help="what joins are ordered by")
    options.add_argument("--strict", action="store_true", help="keep ints and doubles apart in predicates")
    options.add_argument("--flat", action="store_true", help="arithmetic without precedence, bound to the right")
    chosen = options.parse_args(arguments)
    engine = Engine(SparkSession.builder.getOrCreate(), chosen.root, chosen.joins, chosen.strict, "flat_right" if chosen.flat else "standard")
    if chosen.parquet:
        engine.register_folder(chosen.parquet, [os.path.basename(p).removesuffix(".parquet") for p in glob.glob(f"{chosen.parquet}/*.parquet")])
    repl(engine, sys.stdin, sys.stdin.isatty())


if __name__ == "__main__":
    main()
