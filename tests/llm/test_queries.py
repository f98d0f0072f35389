import duckdb

import corpus_pipeline
from riskloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.sql(sql)
        columns = sorted(want.columns)
        rows = sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
        assert sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == rows


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
