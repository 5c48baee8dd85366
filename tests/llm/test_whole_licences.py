"""Whole licence texts."""

from tessella.llm.license_scan import _ISC_WHOLE, license_scan


def test_whole_isc_is_found(spark):
    t = spark.createDataFrame([(1, _ISC_WHOLE), (2, "Head.\n" + _ISC_WHOLE + "\nTail.")], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in license_scan(t).collect()} == {1: ["ISC"], 2: ["ISC"]}
