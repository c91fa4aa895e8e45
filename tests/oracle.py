"""Runs a query and its SQL twin and compares them as sets of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def canonical(rows):
    def one(v):
        if v is None:
            return "~"
        if isinstance(v, float) or type(v).__name__ in ("Decimal", "float32", "float64"):
            return repr(round(float(v), 5) + 0.0)
        return str(v)

    return sorted("|".join(map(one, r)) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = canonical(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = canonical(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert got == want
