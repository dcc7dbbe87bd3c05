"""python -m quern schema plan|validate|status|apply|emit DECLARATION [--root FOLDER] [--inventory FILE]"""

from __future__ import annotations

import argparse
import json
import sys

from quern import schema
from quern.errors import Refused


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="what", required=True)
    s = sub.add_parser("schema")
    s.add_argument("command", choices=["plan", "validate", "status", "apply", "emit"])
    s.add_argument("declaration")
    s.add_argument("--root")
    s.add_argument("--inventory")
    a = p.parse_args(args)
    try:
        unit = schema.load(a.declaration)
        if a.command == "emit":
            print(schema.emit(unit))
            return 0
        if a.command == "validate":
            found = []
            if a.inventory:
                with open(a.inventory, encoding="utf-8") as f:
                    found = schema.verify(unit, json.load(f)["queries"])
            for r in found:
                print(f"{r.code} {r.path}: {r.message}")
            return int(bool(found))
        from pyspark.sql import SparkSession

        from quern.sources.store import Store

        store = Store(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.root or "quern-data")
        found = schema.apply(store, unit) if a.command == "apply" else schema.plan(schema.deployed_unit(store, unit.name), unit)
        for step in found.steps:
            print(f"{step.kind} {step.subject}")
        for r in found.refusals:
            print(f"{r.code} {r.path}: {r.message}")
        if a.command == "status":
            print("current" if not found.steps and not found.refusals else "differs")
        return int(bool(found.refusals))
    except Refused as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
