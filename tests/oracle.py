"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def kind(type_name: str) -> str:
    """Type family, for comparing the schemas of both engines."""
    text = str(type_name).lower()
    if any(x in text for x in ("int", "long")):
        return "integer"
    if any(x in text for x in ("double", "float", "decimal")):
        return "double" if "decimal" not in text else "decimal"
    if "bool" in text:
        return "boolean"
    return "string" if any(x in text for x in ("string", "varchar", "char")) else text


def compare(spark, con, query, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    frame = query.run(spark, sf_dir)
    got_names, got = _canonical(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    want_names, want = _canonical(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    got_types = {f.name: kind(f.dataType.simpleString()) for f in frame.schema.fields}
    want_types = {d[0]: kind(d[1]) for d in cursor.description}
    if got_types != want_types:
        return f"types {got_types} != {want_types}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; extra {set(got) - set(want) and sorted(set(got) - set(want))[:3]}; lacking {sorted(set(want) - set(got))[:3]}"
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"values differ: {pairs}"
    return None


def main(argv):
    import __spark_entry__  # noqa: F401
    from tallyframe.plans.registry import QUERIES
    from tallyframe.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, query in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if query.sql is None:
                result = f"rows only: {query.run(spark, sf_dir).count()}"
            else:
                result = compare(spark, con, query, sf_dir) or "ok"
        except Exception as problem:
            result = f"ERROR {str(problem)[:1500]}"
        print(f"{name:34s} {time.time() - start:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
