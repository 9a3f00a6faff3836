"""``python -m rillforge STATE_FOLDER [status | inspect-offset SOURCE | schema-list SOURCE]``."""

import sys

from pyspark.sql import SparkSession

from .control import UnknownCommand, execute, parse_args
from .state import StateStore


def main(args: list[str]) -> int:
    if not args:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        print(execute(parse_args(args[1:]), StateStore(SparkSession.builder.getOrCreate(), args[0])))
    except UnknownCommand as e:
        print(f"unknown command: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
