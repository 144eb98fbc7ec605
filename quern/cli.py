"""Command line: python -m quern.cli codegen|serialize|run|kinds ...

codegen DIR            Python source of tables for the Parquet tables in a directory
serialize MODULE OUT   writes the manifest of the queries in a module (its Query values)
run MANIFEST NAME      runs a query; --dir DIR, --params JSON, --format json|csv|table, --limit N, --dry-run, --yes
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import re
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from quern.plans import manifest
from quern.plans.query import Query
from quern.sources.formats import as_text
from quern.sources.tables import Database, Table

_MUTATION = re.compile(r"^\s*(?:/\*.*?\*/\s*)?(?:with\b.*?\)\s*)?(insert|update|delete|merge|truncate|drop|alter|create)\b", re.I | re.S)


def is_mutation(text: str) -> bool:
    return bool(_MUTATION.match(text))


def codegen(spark: SparkSession, directory: str) -> str:
    """Declarations that rebuild each table's schema."""
    out = ["from pyspark.sql import types as T", "", "from quern.sources.tables import Table", ""]
    for name in sorted(p[: -len(".parquet")] for p in os.listdir(directory) if p.endswith(".parquet")):
        schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
        out.append(f"{re.sub(r'\W', '_', name).title().replace('_', '')} = Table.from_struct_type({name!r}, T.StructType.fromJson({schema.jsonValue()!r}))")
    return "\n".join(out) + "\n"


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def tables_of(query: Query) -> list[Table]:
    found: dict[str, Table] = {}

    def walk(x: Any) -> None:
        if isinstance(x, Table):
            found[x.name] = x
        elif isinstance(x, Query):
            if id(x) not in seen:
                seen.add(id(x))
                for v in x.parts.values():
                    walk(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                walk(v)
        elif hasattr(x, "__dict__"):
            for v in vars(x).values():
                walk(v)

    seen: set[int] = set()
    walk(query)
    return list(found.values())


def main(argv: list[str] | None = None, out: Any = sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="quern")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("codegen")
    c.add_argument("directory")
    s = commands.add_parser("serialize")
    s.add_argument("module")
    s.add_argument("out")
    r = commands.add_parser("run")
    r.add_argument("manifest")
    r.add_argument("name")
    r.add_argument("--dir", default=".")
    r.add_argument("--params", default="{}")
    r.add_argument("--format", default="table")
    r.add_argument("--limit", type=int)
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--yes", action="store_true")
    a = parser.parse_args(argv)
    if a.command == "codegen":
        print(codegen(_session(), a.directory), file=out)
        return 0
    if a.command == "serialize":
        module = importlib.import_module(a.module)
        found = {k: v for k, v in vars(module).items() if isinstance(v, Query)}
        Path(a.out).write_text(manifest.dumps(found))
        print(f"{len(found)} queries", file=out)
        return 0
    query, params = manifest.loads(Path(a.manifest).read_text())[a.name], json.loads(a.params)
    text, args = query.to_sql(None, params)
    if a.dry_run:
        print(text, file=out)
        print(json.dumps(args, default=str), file=out)
        return 0
    if is_mutation(text) and not a.yes:
        print("The query changes data; run it with --yes.", file=out)
        return 2
    spark = _session()
    db = Database(spark, {t.name: f"{a.dir}/{t.name}.parquet" for t in tables_of(query)})
    df = query.dataframe(db, params)
    df = df if a.limit is None else df.limit(a.limit)
    print(as_text([x.asDict(recursive=True) for x in df.collect()], df.columns, a.format), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
