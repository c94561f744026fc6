"""python -m tidewright run|check SPEC, version, or schema KIND NAME."""

from __future__ import annotations

import json
import sys

from .plans.config import json_schema
from .plans.pipeline import check, run, standard
from .plans.spec import SpecError, load

VERSION = "0.2"
USAGE = "usage: python -m tidewright run SPEC | check SPEC | schema KIND NAME | version"
#: Exit codes: done, refused or failed, not understood.
OK, FAILED, MISUSED = 0, 1, 2


def main(args: list[str]) -> int:
    match args:
        case ["version"]:
            print(VERSION)
            return OK
        case ["schema", kind, name] if (kind, name) in (known := standard().fields):
            print(json.dumps(json_schema(known[kind, name]), indent=2))
            return OK
        case ["check" | "run" as what, path]:
            try:
                with open(path, encoding="utf-8") as f:
                    spec = load(f.read())
                found, contract = check(spec, standard())
            except (OSError, ValueError) as e:  # SpecError is one
                found, contract = [str(e)], None
            if found:
                print("\n".join(found), file=sys.stderr)
                return FAILED
            print(f"{contract.tier}, acknowledged at {contract.ack_point}" + "".join(f"\n  {x}" for x in [*contract.why, *contract.warnings]), file=sys.stderr)
            return OK if what == "check" else _run(spec)
        case _:
            print(USAGE, file=sys.stderr)
            return MISUSED


def _run(spec) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(spec.id).getOrCreate()
    try:
        for sink, how in run(spark, spec, standard()).items():
            print(f"{sink}: {how}", file=sys.stderr)
    except SpecError as e:
        print(e, file=sys.stderr)
        return FAILED
    return OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
