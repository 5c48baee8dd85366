"""Commands on a stored session, and its versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import session
from tessella.plans.pipeline import Settings
from tessella.snapshots import Conflict, Snapshots


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "store"))


def texts(spark, n=36):
    kinds = ["The battery shall supply cell voltage", "The radio shall transmit telemetry frames", "The wheel shall give a torque command"]
    return spark.createDataFrame([(i, f"REQ-{i:03d}", f"{kinds[i % 3]} number {i}.", "m", "s") for i in range(n)], "id long, req_id string, text string, module string, section string")


def vectors(spark, n=36):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, (np.eye(6)[i % 3] * 4 + rng.normal(size=6) / 10).tolist()) for i in range(n)], "id long, embedding array<double>").persist()


def done(spark, store, n=36):
    """A clustered session, without a run: three clusters by kind, two rows of noise."""
    now = session.create(store, 1, texts(spark, n))
    label = F.when(F.col("id") >= n - 2, -1).otherwise((F.col("id") % 3).cast("int"))
    labelled = now.read("requirements").withColumns({"cluster_id": label, "membership_prob": F.lit(0.9)})
    clusters = labelled.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").cast("int").alias("size")).withColumns({"id": F.col("cluster_id") + 1, "label": F.concat(F.lit("Group "), F.col("cluster_id").cast("string")), "keywords": F.array(F.lit("telemetry frames"))})
    return now.commit(requirements=labelled, clusters=clusters, sessions=now.read("sessions").withColumns({"status": F.lit("done"), "total_clusters": F.lit(3)}))


def test_two_writers_and_a_dead_one(spark, store, tmp_path):
    first = session.create(store, 4, texts(spark, 3))
    a, b = store.open(4), store.open(4)
    a.commit(sessions=a.read("sessions").withColumn("name", F.lit("a")))
    with pytest.raises(Conflict):
        b.commit(sessions=b.read("sessions").withColumn("name", F.lit("b")))
    assert [r["name"] for r in store.open(4).read("sessions").collect()] == ["a"] and store.versions(4) == [1, 2]
    assert [r["name"] for r in first.read("sessions").collect()] == [""]  # a reader keeps its version
    # a writer that dies before its manifest is there has changed nothing
    broken = store.open(4)
    boom = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        broken.commit(requirements=broken.read("requirements").withColumn("module", F.lit("new")), sessions=broken.read("sessions").withColumn("name", boom("name")))
    assert rows(store.open(4).read("requirements"), "module") == [("m",)] * 3
    assert store.vacuum(4, keep=1) >= 2 and store.open(4).read("requirements").count() == 3
    with pytest.raises(LookupError):
        store.open(4, 1)
    assert store.open(9).read("clusters").count() == 0


def test_cluster_a_session(spark, store):
    session.create(store, 1, texts(spark))
    made = session.cluster_session(store, 1, Settings(min_cluster_size=6, dims=3, threshold=0.9), vectors(spark))
    row = made.read("sessions").first()
    assert (row["status"], row["total_clusters"], row["noise_count"]) == ("done", 3, 0)
    kinds = {}
    for i, c in rows(made.read("requirements"), "id", "cluster_id"):
        kinds.setdefault(i % 3, set()).add(c)
    assert sorted(map(sorted, kinds.values())) == [[0], [1], [2]]
    assert rows(made.read("clusters"), "cluster_id", "size") == [(0, 12), (1, 12), (2, 12)]
    assert made.read("session_edges").count() == 3 * 66
    # a run that fails leaves its rows; one that goes on refuses a second
    with pytest.raises(Exception, match="broken"):
        session.cluster_session(store, 1, embed=lambda *_: (_ for _ in ()).throw(RuntimeError("broken")))
    now = store.open(1)
    assert now.read("sessions").first()["status"] == "error" and now.read("clusters").count() == 3
    now.commit(sessions=now.read("sessions").withColumn("status", F.lit("processing")))
    with pytest.raises(ValueError, match="being clustered"):
        session.cluster_session(store, 1)
    with pytest.raises(LookupError):
        session.cluster_session(store, 2)


def suggestion(now, **values):
    kinds = {"id": "long", "type": "string", "cluster_a_id": "int", "cluster_b_id": "int", "cluster_id": "int"}
    row = now.store.spark.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in kinds.items()], F.lit("pending").alias("status"))
    return now.append("refinement_suggestions", row.withColumn("id", F.lit(1)))


def test_merge_split_and_reject(spark, store):
    now = done(spark, store)
    now = now.commit(refinement_suggestions=suggestion(now, type="merge", cluster_a_id=0, cluster_b_id=2))
    now = now.commit(refinement_suggestions=suggestion(now, type="split", cluster_id=1), suggestion_sides=spark.range(1, 34, 3).select(F.lit(2).alias("suggestion_id"), F.col("id").alias("requirement_id"), (F.col("id") % 2).cast("int").alias("side")))
    now = now.commit(refinement_suggestions=suggestion(now, type="merge", cluster_a_id=0, cluster_b_id=1))
    before = store.open(1).version
    merged = session.decide_suggestion(store, 1, 1, accept=True)
    assert rows(merged.read("clusters"), "cluster_id", "size") == [(0, 23), (1, 11)]
    assert {c for _, c in rows(merged.read("requirements"), "id", "cluster_id")} == {-1, 0, 1}
    names = dict(rows(merged.read("clusters"), "cluster_id", "label"))
    assert names[1] == "Group 1" and names[0] != "Group 0"  # only what changed is named anew
    audit = merged.read("refinement_audit_log").first()
    assert (audit["action"], audit["before_state"], audit["after_state"]) == ("applied", f'{{"version": {before}}}', f'{{"version": {merged.version}}}')
    clusters, assigned = session.state_at(store, 1, before)
    assert rows(clusters, "cluster_id", "size") == [(0, 12), (1, 11), (2, 11)] and assigned.where("cluster_id = 2").count() == 11
    split = session.decide_suggestion(store, 1, 2, accept=True)
    assert rows(split.read("clusters"), "cluster_id", "size") == [(0, 23), (1, 5), (2, 6)] and split.read("sessions").first()["total_clusters"] == 3
    assert {i % 2 for i, c in rows(split.read("requirements"), "id", "cluster_id") if c == 2} == {1}
    with pytest.raises(ValueError, match="applied"):
        session.decide_suggestion(store, 1, 1, accept=True)
    with pytest.raises(LookupError):
        session.decide_suggestion(store, 1, 77, accept=True)
    out = session.decide_suggestion(store, 1, 3, accept=False)
    assert rows(out.read("refinement_suggestions"), "id", "status") == [(1, "applied"), (2, "applied"), (3, "rejected")]
    assert rows(out.read("refinement_audit_log"), "id", "action") == [(1, "applied"), (2, "applied"), (3, "rejected")]


def test_split_of_a_changed_cluster_is_refused(spark, store):
    now = done(spark, store)
    now.commit(refinement_suggestions=suggestion(now, type="split", cluster_id=1), suggestion_sides=spark.range(1, 25, 3).select(F.lit(1).alias("suggestion_id"), F.col("id").alias("requirement_id"), F.lit(1).alias("side")))
    version = store.open(1).version
    with pytest.raises(ValueError, match="changed"):
        session.decide_suggestion(store, 1, 1, accept=True)
    assert store.open(1).version == version


def test_corrections_and_constrained_clustering(spark, store):
    v = vectors(spark)
    done(spark, store)
    with pytest.raises(ValueError, match="already"):
        session.submit_correction(store, 1, 0, 0, vectors=v)
    with pytest.raises(LookupError):
        session.submit_correction(store, 1, 0, 9, vectors=v)
    with pytest.raises(ValueError, match="no active"):
        session.recluster(store, 1, v)
    moved = session.submit_correction(store, 1, 0, 1, "sends telemetry frames", vectors=v)
    c = moved.read("feedback_corrections").first()
    assert (c["previous_cluster_id"], c["new_cluster_id"], c["status"]) == (0, 1, "pending") and c["confidence_score"] == pytest.approx(0.7)
    assert rows(moved.read("clusters"), "cluster_id", "size") == [(0, 11), (1, 12), (2, 11)]
    pairs = rows(moved.read("constraint_pairs"), "constraint_type", "requirement_a_id", "requirement_b_id")
    assert [p[0] for p in pairs] == ["cannot-link"] * 3 + ["must-link"] * 3 and all(p[1] == 0 and p[2] != 0 and p[2] % 3 == (0 if p[0] == "cannot-link" else 1) for p in pairs)
    moved = session.submit_correction(store, 1, 34, 1, confidence=0.4, vectors=v)
    assert rows(moved.read("feedback_corrections"), "id", "confidence_score")[1] == (2, 0.4)
    again = session.recluster(store, 1, v)
    it = session.quality_history(again).collect()
    assert [(r["iteration"], r["n_clusters"], r["noise_count"], r["cannot_link_pairs"]) for r in it] == [(1, 3, 1, 3)] and it[0]["must_link_pairs"] >= 5
    assert dict(rows(again.read("requirements"), "id", "cluster_id"))[0] == 1 and again.read("sessions").first()["noise_count"] == 1
    assert [r["iteration"] for r in session.quality_history(session.recluster(store, 1, v)).collect()] == [1, 2]


def test_suggestions_and_dependencies_are_stored(spark, store):
    v = vectors(spark)
    now = done(spark, store)
    now.commit(refinement_suggestions=suggestion(now, type="merge", cluster_a_id=0, cluster_b_id=2))
    out = session.store_suggestions(store, 1, v, merge_threshold=-1.0, min_spread=0.0)
    found = out.read("refinement_suggestions")
    assert found.where("type = 'coherence'").count() == 3 and found.where("type = 'merge'").count() == 3 and found.agg(F.min("id")).first()[0] == 2
    splits = found.where("type = 'split'").count()
    assert out.read("suggestion_sides").select("suggestion_id").distinct().count() == splits
    deps = session.store_dependencies(store, 1, threshold=0.3, vectors=v)
    assert deps.read("dependency_nodes").count() == 36
    again = session.store_dependencies(store, 1, threshold=0.3, vectors=v)
    assert rows(again.read("dependency_edges"), "source_id", "target_id") == rows(deps.read("dependency_edges"), "source_id", "target_id")


def test_progress_from_another_thread(spark, store):
    from pyspark import InheritableThread

    from tessella.plans.progress import Progress

    session.create(store, 1, texts(spark))
    v, seen, progress = vectors(spark), [], Progress(spark, "session 1")
    thread = InheritableThread(target=lambda: session.cluster_session(store, 1, Settings(min_cluster_size=6, dims=3, threshold=0.9), v, progress=progress))
    thread.start()
    while thread.is_alive():
        seen.append(progress.read())
        thread.join(0.1)
    seen.append(progress.read())
    shares = [s["progress"] for s in seen]
    assert shares == sorted(shares) and seen[-1]["step"] == "done" and shares[-1] == 100
    steps = list(dict.fromkeys(s["step"] for s in seen))
    order = ["starting", "embed", "reduce", "cluster", "label", "graph", "store", "done"]
    assert steps == [s for s in order if s in steps] and len(steps) >= 4
    assert any(s["tasks"] for s in seen) and len(set(shares)) > len(steps)  # tasks fill the way between steps
    failed = Progress(spark)
    with pytest.raises(RuntimeError):
        session.cluster_session(store, 1, embed=lambda *_: (_ for _ in ()).throw(RuntimeError("no vectors")), progress=failed)
    assert failed.read() | {"tasks": 0, "tasks_done": 0} == {"step": "error", "progress": 0.0, "message": "no vectors", "tasks": 0, "tasks_done": 0}
