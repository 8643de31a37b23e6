"""Holds a registered query against its DuckDB SQL on one scale of the test tables."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return str(value)


def same(spark, query, sql, sf_dir):
    import duckdb

    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    ours = sorted([plain(row[c]) for c in columns] for row in found.collect())
    with duckdb.connect() as con:
        con.execute("SET timezone = 'UTC'")
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        relation = con.sql(sql)
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        theirs = sorted([plain(row[i]) for i in at] for row in relation.fetchall())
    assert ours == theirs
    return len(ours)
