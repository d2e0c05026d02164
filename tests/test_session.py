from quillmill.session import cut, discard, settle, table


def test_tables_are_spread_without_a_change_of_rows(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents", spread=True)
    assert b.rdd.getNumPartitions() >= 4 and sorted(r.doc_id for r in a.select("doc_id").collect()) == sorted(r.doc_id for r in b.select("doc_id").collect())


def test_lineage_is_cut(spark):
    d = spark.range(100).selectExpr("id", "id * 2 v")
    assert cut(d).where("v = 4").count() == 1
    s = settle(d)
    assert s.dtypes == d.dtypes and s.where("v = 4").count() == 1
    discard(s)
