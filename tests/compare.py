"""Comparison of a Spark result with DuckDB SQL over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr([plain(r[c]) for c in names]) for r in df.collect())


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.sql(sql)
    names = result.columns
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())
