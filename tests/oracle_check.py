"""Rows of a query and of its SQL, compared as multisets."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark: SparkSession, query, sql: str, sf_dir: str) -> tuple[int, int, list, list]:
    """Rows of the query and of the SQL, and some that only one has."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = Counter(tuple(r) for r in df.select(*names).collect())
    found = connection(sf_dir).execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != names:
        return sum(mine.values()), -1, names, sorted(columns)
    order = [columns.index(n) for n in names]
    theirs = Counter(tuple(r[k] for k in order) for r in found.fetchall())
    return sum(mine.values()), sum(theirs.values()), list((mine - theirs))[:3], list((theirs - mine))[:3]
