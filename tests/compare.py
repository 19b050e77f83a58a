"""Row sets of Spark and of DuckDB in one comparable form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    return cols, sorted("|".join(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
