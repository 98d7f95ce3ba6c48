import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def test_every_query_has_sql_with_the_same_columns(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    db = duckdb.connect()
    for name in os.listdir(SF):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
    light = ("search_profile", "knn_topk", "rrf_fuse", "latency_summary", "replayed_catalog", "product_validation", "upsert")
    for name in light:
        rows = queries[name](spark, SF)
        result = db.execute(sql[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(rows.columns), name
        order = [columns.index(c) for c in sorted(columns)]
        expected = sorted(repr([r[i] for i in order]) for r in result.fetchall())
        assert sorted(repr([r[c] for c in sorted(columns)]) for r in rows.collect()) == expected, name


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["strategy", "qid", "product_id", "rank", "score"] and rows.count() == 400
