"""Run a check in Spark and its SQL in DuckDB and say where they differ.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks.registry import ORACLES, QUERIES, load

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark types and the DuckDB types that hold the same values.
TYPES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def _value(x):
    if x is None or x != x:
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def differences(spark, con, folder: str, name: str) -> list[str]:
    """What differs between the two results; empty if they are equal."""
    result = QUERIES[name](spark, folder)
    columns = sorted(result.columns)
    rows = result.select(*columns).collect()
    if name not in ORACLES:
        return [] if rows else ["no rows"]
    relation = con.sql(ORACLES[name])
    if sorted(relation.columns) != columns:
        return [f"columns {columns} and {sorted(relation.columns)}"]
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    found = [
        f"type of {c}: {dict(result.dtypes)[c]} and {types[c]}"
        for c in columns
        if types[c] not in TYPES.get(dict(result.dtypes)[c], {types[c]})
    ]
    order = [relation.columns.index(c) for c in columns]
    theirs = Counter(tuple(_value(r[i]) for i in order) for r in relation.fetchall())
    ours = Counter(tuple(_value(x) for x in r) for r in rows)
    if ours != theirs:
        found.append(
            f"rows {sum(ours.values())} and {sum(theirs.values())}; "
            f"only here {list((ours - theirs).items())[:2]}; only there {list((theirs - ours).items())[:2]}"
        )
    elif not rows:
        found.append("no rows")
    return found


def main(arguments: list[str]) -> int:
    from pyspark.sql import SparkSession

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    load()
    wanted = [n for n in QUERIES if not arguments[1:] or any(n.startswith(a) for a in arguments[1:])]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            found = differences(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok':5}{time.time() - start:6.1f}s {name}", flush=True)
        for line in found:
            print(f"       {line}")
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
