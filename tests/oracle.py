"""Compare one registered query with its SQL check on the same parquet tables."""

from __future__ import annotations

import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return plain(tuple(value))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(plain(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(plain(tuple(r[i] for i in order)) for r in cur.fetchall())
    return sorted(names), rows


def compare(name, query, sql, spark, sf_dir) -> str | None:
    """None when equal, else what differs."""
    names, ours = spark_rows(query(spark, sf_dir))
    if sql is None:
        return None
    theirs_names, theirs = duck_rows(sql, sf_dir)
    if names != theirs_names:
        return f"{name}: columns {names} != {theirs_names}"
    if ours != theirs:
        missing, extra = list((theirs - ours).items())[:3], list((ours - theirs).items())[:3]
        return (
            f"{name}: {sum(ours.values())} rows != {sum(theirs.values())}\n"
            f"  only in SQL: {missing}\n  only in Spark: {extra}"
        )
    return None
