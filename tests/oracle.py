"""Comparing Spark rows with DuckDB's, as unordered bags."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return round(v, 9) if isinstance(v, float) else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def duck(sql, views):
    c = duckdb.connect()
    for name, path in views.items():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    done = c.execute(sql)
    return [d[0] for d in done.description], done.fetchall()


def assert_same(df, sql, views):
    names, rows = duck(sql, views)
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, rows)
