"""Compares a query with its oracle, order and column order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    norm = lambda v: "∅" if v is None or v != v else (f"{float(v):.6f}" if isinstance(v, float) else str(v))
    return list(df.columns), sorted(tuple(norm(v) for v in r) for r in df.astype(object).itertuples(index=False))
