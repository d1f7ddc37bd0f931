"""The query tool: python -m framewright.tool ACTION TABLE SELECTOR. Actions register themselves by name."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.predicates import select
from .sources import staged


class Action:
    """run(df, args) of the selected rows, and arguments(parser) of its own."""

    def __init__(self, name: str, run: Callable[[DataFrame, argparse.Namespace], None], help_: str, arguments: Callable[[argparse.ArgumentParser], None] | None):
        self.name, self.run, self.help, self.arguments = name, run, help_, arguments


ACTIONS: dict[str, Action] = {}


def action(name: str, arguments: Callable[[argparse.ArgumentParser], None] | None = None) -> Callable:
    """Registers a function as an action; its docstring is the help."""

    def add(run: Callable[[DataFrame, argparse.Namespace], None]):
        if name in ACTIONS:
            raise ValueError(f"{name} is taken")
        ACTIONS[name] = Action(name, run, (run.__doc__ or "").strip(), arguments)
        return run

    return add


def _fields(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--fields", help="columns, separated by commas")


def _target(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("target")
    parser.add_argument("--force", action="store_true", help="replace a target that exists")


@action("print", _fields)
def print_rows(df: DataFrame, args: argparse.Namespace) -> None:
    """Prints the rows as JSON lines, read partition by partition."""
    names = args.fields.split(",") if args.fields else df.columns
    for r in df.select(F.to_json(F.struct(*[f"`{n}`" for n in names])).alias("line")).toLocalIterator():
        print(r.line)


@action("count")
def count_rows(df: DataFrame, args: argparse.Namespace) -> None:
    """Prints how many rows there are."""
    print(df.count())


@action("write", _target)
def write_rows(df: DataFrame, args: argparse.Namespace) -> None:
    """Writes the rows as JSON lines, as a whole or not at all."""
    staged.publish(df, args.target, force=args.force)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewright.tool", description=__doc__)
    actions = top.add_subparsers(title="Actions", dest="action")
    for a in ACTIONS.values():
        own = actions.add_parser(a.name, help=a.help)
        own.add_argument("table", help="a folder or file that Spark reads")
        own.add_argument("selector", help="* or field[:type]=value or field[:type]=low-high, separated by commas")
        own.add_argument("--format", default="parquet")
        own.add_argument("--order", help="columns, separated by commas, by which the first are taken", default="")
        own.add_argument("--max-entries", type=int)
        own.add_argument("-v", "--verbosity", action="count", default=0, help="more log lines")
        if a.arguments:
            a.arguments(own)
    return top


def main(words: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(words)
    if not args.action:
        parser().print_help(sys.stdout)
        return 0
    spark = spark or SparkSession.builder.appName("framewright.tool").getOrCreate()
    if args.verbosity:
        spark.sparkContext.setLogLevel("INFO" if args.verbosity == 1 else "DEBUG")
    df = spark.read.format(args.format).load(args.table)
    ACTIONS[args.action].run(select(df, args.selector, args.max_entries, [c for c in args.order.split(",") if c]), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
