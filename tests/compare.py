"""Rows of a Spark query against DuckDB's for its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c.execute(sql).df()


def rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


def same(spark_df, sql, sf_dir):
    ours, theirs = spark_df.toPandas(), duck(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
