"""Loaders, dispatch, timing and wording."""

import pytest
from pyspark.sql import functions as F

from tessella.operators.reads import cluster_detail, load_session, newest_first, shown, timed
from tessella.operators.suggest import cluster_summary, split_rationale, worded
from tessella.sources.export import export_session


def test_loaders_refuse(spark):
    sessions = spark.createDataFrame([(1, "done", "2020"), (2, "processing", "2021")], "id long, status string, created_at string")
    assert load_session(sessions, 1, "done").count() == 1
    with pytest.raises(LookupError):
        load_session(sessions, 3)
    with pytest.raises(ValueError):
        load_session(sessions, 2, "done")
    assert [r["id"] for r in newest_first(sessions).collect()] == [2, 1]
    with pytest.raises(LookupError):
        cluster_detail(spark.createDataFrame([(1, "a", 2)], "cluster_id int, label string, size int"), sessions, 9)
    with pytest.raises(ValueError):
        shown(sessions, noise="some")


def test_dispatch(spark):
    rq = spark.createDataFrame([(1, "R1", "t", "m", "", 0, 0.5)], "id long, req_id string, text string, module string, section string, cluster_id int, membership_prob double")
    cl = spark.createDataFrame([(0, "c", 1)], "cluster_id int, label string, size int")
    no = spark.createDataFrame([], "source_id long, target_id long, relation string, weight double")
    for kind, end in (("reqif", "reqif"), ("SysML", "xmi"), ("jama", "json"), ("csv", "csv")):
        out, media, name = export_session(kind, 7, "s", rq, cl, no, "2000-01-01T00:00:00Z")
        assert out.count() == 1 and name == f"session_7.{end}" and "/" in media
    with pytest.raises(ValueError):
        export_session("pdf", 7, "s", rq, cl, no, "")


def test_timed():
    took = {}
    with pytest.raises(KeyError), timed(took, "a"):
        raise KeyError
    assert took["a"] >= 0


def test_wording(spark):
    row = spark.range(1).select(
        split_rationale(F.lit("c"), F.lit(0.5), F.lit(12.0), F.lit(0.4), F.lit(3), F.lit(4)).alias("s"), split_rationale(F.lit("c"), F.lit(0.5), F.lit(12.0), F.lit(0.1), F.lit(3), F.lit(4)).alias("n"),
        cluster_summary(F.lit("c"), F.array(*[F.lit(x) for x in "abcdef"]), F.array(F.lit("x" * 130))).alias("k"), cluster_summary(F.lit("c"), F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e"),
        worded(F.lit("  "), F.lit("t")).alias("w"), worded(F.lit(" said "), F.lit("t")).alias("v")).first()
    assert row["s"] == 'Cluster "c" shows a bimodal distribution (bimodality score: 0.500, BIC improvement: 12.0). The two identified sub-groups contain 3 and 4 requirements respectively. The cluster has high internal spread (0.400), supporting the case for splitting. Splitting would create more focused clusters with tighter semantic coherence.'
    assert "spread" not in row["n"] and row["w"] == "t" and row["v"] == "said"
    assert row["k"] == f'Cluster "c" covers requirements related to a, b, c, d, e. Representative requirements include: "{"x" * 120}".' and row["e"] == 'Cluster "c" contains related requirements.'


def test_fixture_rows(spark):
    from tessella.sources import fixtures

    rows = fixtures.requirements(spark, 20).orderBy("id").collect()
    assert [r["req_id"] for r in rows[:2]] == ["REQ-00000", "REQ-00001"] and len(rows) == 20
    assert all(r["module"] in fixtures.SUBSYSTEMS and "{" not in r["text"] for r in rows)
