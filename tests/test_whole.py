"""Whole jobs where a query once took a part."""

from arbora.plans import catalog


def test_version_order_ranks_all_names(spark, tmp_path):
    spark.createDataFrame([(f"Brand#{i}",) for i in range(1500)], "p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r["rank"], r["name"]) for r in catalog.version_order(spark, str(tmp_path)).collect())
    assert got == [(i + 1, f"Brand#{i}") for i in range(1500)]
