"""ranked_lists_compared against its SQL, where two lists have nothing in common."""

import duckdb

from lakefind.plans import registry


def test_lists_without_a_common_result(spark, tmp_path):
    # question 1: short texts are the best by BM25, long ones have more of its terms; question 2: the same lists
    docs = [(k, "alpha beta " + "filling " * 2000) for k in range(12)] + [(k, "alpha alpha alpha") for k in range(12, 30)] + [(k, f"gamma {'word ' * (k - 29)}") for k in range(30, 36)]
    docs += [(k, "other") for k in range(36, 60)]
    tables = {"documents": (docs, "doc_id long, text string"), "benchmark": ([(1, "alpha beta"), (2, "gamma"), (3, "absent")], "item_id long, text string")}
    con = duckdb.connect()
    for name, (rows, kind) in tables.items():
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(path)
        con.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')")
    sql = con.execute(registry.oracle_sql()["ranked_lists_compared"])
    columns = [c[0] for c in sql.description]
    want = sorted(sql.fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in registry.queries()["ranked_lists_compared"](spark, str(tmp_path)).collect())
    at = columns.index("kept")
    assert got == want and [r[at] for r in got] == [None, 6]
