"""Compare registered queries with their SQL on the driver tables."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def types_match(df, con, sql: str) -> list[str]:
    """Columns whose Spark and SQL types differ."""
    wanted = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT",
    }
    mine = {f.name: wanted.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{c}: {mine[c]} / {theirs.get(c)}" for c in mine if mine[c] != theirs.get(c)]


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> str:
    df = fn(spark, sf)
    columns, mine = spark_rows(df)
    if sql is None:
        return "" if mine else "no rows"
    their_columns, theirs = duck_rows(con, sql)
    if columns != their_columns:
        return f"columns {columns} / {their_columns}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}: only spark {sorted(set(mine) - set(theirs), key=repr)[:2]!r:.800} only sql {sorted(set(theirs) - set(mine), key=repr)[:2]!r:.800}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"values {columns}\n   spark {a!r:.700}\n   sql   {b!r:.700}"
    if not mine:
        return "no rows"
    wrong = types_match(df, con, sql)
    return f"types {wrong}" if wrong else ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    from paperlode.session import local_session

    sf = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf = a
        else:
            names.append(a)
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    bad = 0
    for name in chosen:
        began = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            problem = f"error {type(e).__name__} {str(e)[:900]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - began:.1f}s {'' if name in oracles else '(no sql)'} {problem}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]) > 0)
