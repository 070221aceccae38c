"""Shared by the tests of the training-data operators."""

import duckdb

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, *(None, None)[:4 - len(r)], len(r[1] or "")) for r in rows], DOCS)


def same_as_sql(df, sql, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r[n] for n in names) for r in df.collect()) == order(cur.fetchall())
