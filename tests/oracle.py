"""Compare a query's rows with those of its SQL."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(r[n]) for n in names) for r in df.select(*names).collect()), names


def rows_of_sql(con, sql):
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall()), [got.columns[i] for i in order]
