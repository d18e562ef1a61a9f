import pytest
from pyspark.sql import functions as F

from corpusflow.plans import fixtures as X
from corpusflow.sources.tables import read_table, write_snapshot


def test_snapshots_keep_their_schema_and_are_not_overwritten(spark, sf, tmp_path):
    rows = X.articles(spark, sf)
    path = str(tmp_path / "articles")
    write_snapshot(rows, path, F.col("created_at"))
    back = read_table(spark, path, "articles", ["id", "author", "hot_score"])
    assert back.count() == rows.count() and back.where("author is not null").isEmpty()
    assert sorted(r.id for r in back.collect()) == sorted(r.id for r in rows.select("id").collect())
    with pytest.raises(Exception, match="already exists"):
        write_snapshot(rows, path)
