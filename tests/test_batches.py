"""Tables of whole texts reach Python in batches bounded by rows and bytes."""

import pyarrow as pa

from lakefind.sources.tables import read


def test_batches_of_long_texts_are_small(spark, tmp_path):
    session = spark.newSession()
    session.range(3000).selectExpr("id as doc_id", "repeat('x', 200) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    n = [r.n for r in read(session, str(tmp_path), "documents").mapInArrow(rows, "n long").collect()]
    assert sum(n) == 3000 and max(n) <= 1000
