"""Enrichment results whose requirements share a req_id."""

import duckdb
from pyspark.sql import functions as F

from tessella.operators.reads import enrichment_view
from tessella.queries import ORACLES, QUERIES


def test_repeated_req_ids_repeat_no_result(spark):
    results = spark.createDataFrame([(1, "R", "one", 0.5), (2, "R", "two", 0.5)], "requirement_db_id long, requirement_id string, expanded_text string, confidence double")
    requirements = spark.createDataFrame([(1, "R", "a command"), (2, "R", "a report")], "id long, req_id string, text string")
    assert [r["expanded_text"] for r in enrichment_view(results, requirements, "command").collect()] == ["one"]
    assert sorted(r["expanded_text"] for r in enrichment_view(results, requirements).collect()) == ["one", "two"]
    assert enrichment_view(results, requirements).columns == results.columns


def test_ids_of_five_digits_are_cut_to_four(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    rows.unionByName(rows.withColumn("vec_id", F.col("vec_id") * 10 + 4)).withColumn("vec_id", F.col("vec_id") + 1000).dropDuplicates(["vec_id"]).unionByName(rows.withColumn("vec_id", F.col("vec_id") + 10_000)).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = con.execute(ORACLES["q78_enrichment_filter"])
    assert [x[0] for x in cursor.description] == ["requirement_id", "status", "confidence"]
    assert sorted(tuple(r) for r in QUERIES["q78_enrichment_filter"](spark, str(tmp_path)).collect()) == sorted(cursor.fetchall())
