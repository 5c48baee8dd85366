"""Commands on a stored session: each reads one version of its tables and commits the next, all tables at once or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comment_confidence
from ..lineage import cut
from ..plans.pipeline import Settings, run
from ..snapshots import Snapshot, Snapshots
from ..sources.providers import enrich_missing
from ..tables import ENRICHMENT_KEY
from . import commands, constraints, dependency, refine, suggest
from .cluster import embed_hash
from .ingest import number_rows
from .reads import load_session
from .terms import expansion_quality, label_clusters
from .vectors import cluster_quality, representatives, silhouette



def _now():
    return F.current_timestamp().cast("timestamp_ntz")


def create(store: Snapshots, session_id: int, rows: DataFrame, name: str = "", filename: str = "") -> Snapshot:
    """A session of rows(id, req_id, text, module, section) that waits to be clustered."""
    n = rows.count()
    if not n:
        raise ValueError("no rows")
    session = store.spark.createDataFrame([(session_id, name, filename, n)], "id long, name string, filename string, total_requirements int").withColumns({"created_at": _now(), "status": F.lit("uploaded"), "total_clusters": F.lit(0), "noise_count": F.lit(0)})
    extra = {"cluster_id": "int", "membership_prob": "double", "umap_x": "double", "umap_y": "double", "is_noise": "boolean"}
    typed = rows.withColumns({c: (F.col(c) if c in rows.columns else F.lit(None)).cast(t) for c, t in extra.items()})
    return store.open(session_id).commit(sessions=session, requirements=typed)


def _done(now: Snapshot) -> DataFrame:
    return load_session(now.read("sessions"), now.session_id, "done")


def _points(now: Snapshot, vectors: DataFrame | None, embed) -> DataFrame:
    """(idx, text, label, prob, embedding) of a session's requirements; vectors(id, embedding) or what embed makes of the texts."""
    rows = now.read("requirements").select(F.col("id").alias("idx"), "req_id", "text", F.coalesce("cluster_id", F.lit(-1)).alias("label"), F.coalesce("membership_prob", F.lit(1.0)).alias("prob"))
    return embed(rows) if vectors is None else rows.join(vectors.select(F.col("id").alias("idx"), "embedding"), "idx")


def _cluster_rows(labelled: DataFrame) -> DataFrame:
    found = label_clusters(labelled)
    return number_rows(found, "label", "id").select((F.col("id") + 1).alias("id"), F.col("label").cast("int").alias("cluster_id"), F.col("name").alias("label"), "keywords", F.col("size").cast("int").alias("size"))


def cluster_session(store: Snapshots, session_id: int, settings: Settings = Settings(), vectors: DataFrame | None = None, enriched: DataFrame | None = None, embed=embed_hash, progress=None) -> Snapshot:
    """Cluster a session's texts, or their expansions enriched(id, enriched) by the settings' mode, and store rows, clusters and graph.

    While it runs, the session is 'processing' and a second call is refused;
    a run that fails leaves it in 'error' with its old rows. progress (a
    plans.progress.Progress, say) hears of every step.
    """
    now = store.open(session_id)
    row = load_session(now.read("sessions"), session_id)
    if row.first()["status"] == "processing":
        raise ValueError(f"session {session_id} is being clustered")
    if settings.mode != "base" and enriched is None:
        raise ValueError("this mode needs expanded texts")
    say = progress or (lambda step, share, message: None)
    say("starting", 0, "starting")
    now = now.commit(sessions=row.withColumn("status", F.lit("processing")))
    try:
        texts = now.read("requirements").select(F.col("id").alias("idx"), "text")
        if enriched is not None:
            texts = texts.join(enriched.select(F.col("id").alias("idx"), "enriched"), "idx", "left")
        if vectors is not None:
            texts = texts.join(vectors.select(F.col("id").alias("idx"), "embedding"), "idx")
        made = run(texts, settings, embed, lambda step, share, message: None if step == "done" else say(step, share, message))
        say("store", 95, "storing")
        placed = cut(made["requirements"].select("idx", F.col("label").cast("int").alias("label"), "prob", "x", "y", "is_noise"))
        rows = now.read("requirements").drop("cluster_id", "membership_prob", "umap_x", "umap_y", "is_noise").join(placed.withColumnsRenamed({"idx": "id", "label": "cluster_id", "prob": "membership_prob", "x": "umap_x", "y": "umap_y"}), "id")
        labelled = texts.select("idx", "text").join(placed, "idx")
        totals = cluster_quality(placed).first()
        session = row.withColumns({"status": F.lit("done"), "total_clusters": F.lit(totals["n_clusters"]).cast("int"), "noise_count": F.lit(totals["noise_count"]).cast("int")})
        edges = made["edges"].select(F.col("source").cast("int"), F.col("target").cast("int"), "weight")
        stored = now.commit(sessions=session, requirements=rows, clusters=_cluster_rows(labelled), session_edges=edges)
        say("done", 100, "done")
        return stored
    except Exception as e:
        say("error", 0, str(e)[:500])
        now.commit(sessions=row.withColumn("status", F.lit("error")))
        raise


def enrich_session(store: Snapshots, session_id: int, provider, prompt_version: str, force: bool = False, mode: str = "hybrid", **asking) -> Snapshot:
    """Expand a session's texts: results that still hold stay, the others are asked for (all of them, if force) and stored with their quality, failures included."""
    now = store.open(session_id)
    load_session(now.read("sessions"), session_id)
    rows = now.read("requirements").select("id", "text", "req_id")
    old = now.read("enriched_requirements")
    _, made = enrich_missing(rows, old, provider, prompt_version, force, **asking)
    named = made.join(rows.select(F.col("id").alias("requirement_db_id"), F.col("req_id").alias("requirement_id"), F.col("text").alias("__text")), "requirement_db_id")
    judged = expansion_quality(named.withColumn("warnings_", F.col("warnings")).drop("warnings"), "__text", "expanded_text")
    report = F.to_json(F.struct("status", "length_ratio", "lexical_overlap", "domain_term_coverage", "missing_tokens", "invented_numbers", "changed_obligation", "risk", "adjusted_confidence", "warnings"))
    judged = judged.withColumn("quality_report", report).withColumn("warnings", F.when(F.col("status") == "failed", F.array("error_message")).otherwise(F.col("warnings_")))
    fresh = number_rows(judged, "requirement_db_id", "id").withColumns({"id": F.col("id") + 1, "embedding_mode_recommended": F.lit(mode), "created_at": _now(), "updated_at": _now()})
    kept = old.join(fresh.select(*ENRICHMENT_KEY[1:]), ENRICHMENT_KEY[1:], "left_anti").select("id")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    all_rows = now.append("enriched_requirements", fresh)
    return now.commit(enriched_requirements=all_rows.join(kept.withColumn("__old", F.lit(True)), "id", "left").where((F.col("id") > top) | F.col("__old")).drop("__old"))


def store_suggestions(store: Snapshots, session_id: int, vectors: DataFrame | None = None, embed=embed_hash, **settings) -> Snapshot:
    """Generate suggestions; pending ones from before go, decided ones stay. Which side of a split a row would be on is stored by row."""
    now = store.open(session_id)
    _done(now)
    points = cut(_points(now, vectors, embed))
    found = cut(number_rows(suggest.generate_suggestions(points, now.read("clusters").select("cluster_id", "label"), **settings).withColumn("__o", F.struct("type", "cluster_a_id", "cluster_b_id", "cluster_id")), "__o", "id").drop("__o").withColumn("id", F.col("id") + 1))
    top = now.read("refinement_suggestions").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    pending = now.read("refinement_suggestions").where("status = 'pending'").select("id")
    kept = now.append("refinement_suggestions", found.withColumns({"created_at": _now(), "updated_at": _now()}))
    fresh = F.col("id") > top
    kept = kept.where(fresh | (F.col("status") != "pending"))
    split = found.where("type = 'split'").select((F.col("id") + top).alias("suggestion_id"), "cluster_id")
    halves = refine.split_sides(points, **{k: v for k, v in settings.items() if k in ("vector", "min_spread")})
    sides = halves.join(split, F.col("label") == F.col("cluster_id")).select("suggestion_id", F.col("idx").alias("requirement_id"), "side")
    old = now.read("suggestion_sides").join(pending.withColumnRenamed("id", "suggestion_id"), "suggestion_id", "left_anti")
    return now.commit(refinement_suggestions=kept, suggestion_sides=old.select("suggestion_id", "requirement_id", "side").unionByName(sides))


def decide_suggestion(store: Snapshots, session_id: int, suggestion_id: int, accept: bool, by: str = "user") -> Snapshot:
    """Reject a pending suggestion, or merge or split as it says.

    Rows move, the clusters concerned are named and counted anew from their
    texts, totals follow, and the audit log names the versions before and
    after, which hold the whole state. A split whose cluster has changed
    since is an error, and so is a suggestion that is not pending.
    """
    now = store.open(session_id)
    session = _done(now) if accept else load_session(now.read("sessions"), session_id)
    s = now.read("refinement_suggestions").where(F.col("id") == suggestion_id).select("status", "type", "cluster_a_id", "cluster_b_id", "cluster_id").first()
    if s is None:
        raise LookupError(f"no suggestion {suggestion_id}")
    if s["status"] != "pending":
        raise ValueError(f"suggestion {suggestion_id} is {s['status']}")
    own = F.col("id") == suggestion_id
    status = F.when(own, "applied" if accept else "rejected").otherwise(F.col("status"))
    decided = now.read("refinement_suggestions").withColumns({"status": status, "updated_at": F.when(own, _now()).otherwise(F.col("updated_at"))})
    before = f'{{"version": {now.version}}}' if accept else None
    after = f'{{"version": {now.version + 1}}}' if accept else None
    entry = store.spark.createDataFrame([(1, suggestion_id, "applied" if accept else "rejected", before, after, by)], "id long, suggestion_id long, action string, before_state string, after_state string, applied_by string").withColumn("created_at", _now())
    audit = now.append("refinement_audit_log", entry)
    if not accept:
        return now.commit(refinement_suggestions=decided, refinement_audit_log=audit)
    rows, clusters = now.read("requirements"), now.read("clusters")
    if s["type"] == "merge":
        old = [s["cluster_a_id"], s["cluster_b_id"]]
        moved = rows.withColumn("cluster_id", F.when(F.col("cluster_id") == old[1], F.lit(old[0])).otherwise(F.col("cluster_id")))
        alive = [old[0]]
    elif s["type"] == "split":
        new = clusters.agg(F.coalesce(F.max("cluster_id") + 1, F.lit(1))).first()[0]
        sides = now.read("suggestion_sides").where(F.col("suggestion_id") == suggestion_id).select(F.col("requirement_id").alias("id"), "side")
        members = rows.where(F.col("cluster_id") == s["cluster_id"])
        if members.join(sides, "id", "full").where("side IS NULL OR cluster_id IS NULL").limit(1).count():
            raise ValueError("the cluster has changed since the suggestion was made")
        moved = rows.join(sides, "id", "left").withColumn("cluster_id", F.when((F.col("cluster_id") == s["cluster_id"]) & (F.col("side") == 1), F.lit(new)).otherwise(F.col("cluster_id"))).drop("side")
        old = alive = [s["cluster_id"], new]
    else:
        raise ValueError(f"a suggestion of type {s['type']} can't be applied")
    moved = cut(moved)
    again = label_clusters(moved.where(F.col("cluster_id").isin(alive)).select(F.col("id").alias("idx"), "text", F.col("cluster_id").alias("label")))
    top = clusters.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids = clusters.select("cluster_id", "id")
    named = again.select(F.col("label").alias("cluster_id"), F.col("name").alias("label"), "keywords", F.col("size").cast("int").alias("size")).join(ids, "cluster_id", "left").withColumn("id", F.coalesce("id", F.lit(top + 1)))
    left = clusters.where(~F.col("cluster_id").isin(old)).select("id", "cluster_id", "label", "keywords", "size").unionByName(named.select("id", "cluster_id", "label", "keywords", "size"))
    left = cut(left)
    session = session.withColumn("total_clusters", F.lit(left.count()).cast("int"))
    return now.commit(sessions=session, requirements=moved, clusters=left, refinement_suggestions=decided, refinement_audit_log=audit)


def state_at(store: Snapshots, session_id: int, version: int) -> tuple[DataFrame, DataFrame]:
    """What the audit log means by a version: clusters(cluster_id, label, size) and assignments(id, cluster_id)."""
    then = store.open(session_id, version)
    return then.read("clusters").select("cluster_id", "label", "size"), then.read("requirements").select("id", "cluster_id")


def submit_correction(store: Snapshots, session_id: int, requirement_id: int, cluster_id: int | None, comments: str = "", confidence: float | None = None, by: str = "Expert Analyst", vectors: DataFrame | None = None, embed=embed_hash, n: int = 3) -> Snapshot:
    """Move one row to another cluster (None or -1: noise), with a pending correction, cluster sizes, and must-link and cannot-link pairs to the representatives of the new and the old cluster.

    A comment sets the confidence where none was given or it was 1.
    """
    now = store.open(session_id)
    rows, clusters = now.read("requirements"), now.read("clusters")
    row = rows.where(F.col("id") == requirement_id).select("cluster_id").first()
    if row is None:
        raise LookupError(f"no requirement {requirement_id}")
    if row["cluster_id"] == cluster_id:
        raise ValueError("the row is in this cluster already")
    target = clusters.where(F.col("cluster_id") == F.lit(cluster_id)).select("label", "keywords").first()
    if target is None and cluster_id not in (None, -1):
        raise LookupError(f"no cluster {cluster_id}")
    comments = comments.strip()
    if comments and confidence in (None, 1.0):
        label, words = (target["label"], target["keywords"] or []) if target else ("Noise", [])
        said = store.spark.createDataFrame([(comments, label, words)], "c string, l string, k array<string>")
        confidence = said.select(comment_confidence("c", F.col("l"), F.col("k"))).first()[0]
    confidence = 1.0 if confidence is None else confidence
    correction = store.spark.createDataFrame([(1, requirement_id, row["cluster_id"], cluster_id, confidence, comments, by, "pending")], "id long, requirement_id long, previous_cluster_id int, new_cluster_id int, confidence_score double, comments string, applied_by string, status string").withColumns({"created_at": _now(), "updated_at": _now()})
    corrections = now.append("feedback_corrections", correction)
    last = now.read("feedback_corrections").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    moved = rows.withColumn("cluster_id", F.when(F.col("id") == requirement_id, F.lit(cluster_id)).otherwise(F.col("cluster_id")))
    step = F.when(F.col("cluster_id") == F.lit(row["cluster_id"]), -1).when(F.col("cluster_id") == F.lit(cluster_id), 1).otherwise(0)
    sizes = clusters.withColumn("size", F.greatest(F.col("size") + step, F.lit(0)).cast("int"))
    after = _points(now, vectors, embed).withColumn("label", F.when(F.col("idx") == requirement_id, F.coalesce(F.lit(cluster_id).cast("int"), F.lit(-1))).otherwise(F.col("label")))
    tied = constraints.generate_constraints(after, correction.withColumn("id", F.lit(last)), n)
    tied = number_rows(tied.withColumn("__o", F.struct("type", "b")), "__o", "id").select((F.col("id") + 1).alias("id"), F.col("a").alias("requirement_a_id"), F.col("b").alias("requirement_b_id"), F.col("type").alias("constraint_type"), "feedback_id", _now().alias("created_at"))
    return now.commit(requirements=moved, clusters=sizes, feedback_corrections=corrections, constraint_pairs=now.append("constraint_pairs", tied))


def recluster(store: Snapshots, session_id: int, vectors: DataFrame | None = None, embed=embed_hash) -> Snapshot:
    """Apply the constraints whose correction was not rejected: must-links by their components, then cannot-links; rows, clusters, totals and an iteration with its quality are stored."""
    now = store.open(session_id)
    session = _done(now)
    points = cut(_points(now, vectors, embed))
    pairs = constraints.active_pairs(now.read("constraint_pairs").select(F.col("requirement_a_id").alias("a"), F.col("requirement_b_id").alias("b"), F.col("constraint_type").alias("type"), "feedback_id"), now.read("feedback_corrections"))
    ids = points.select("idx")
    pairs = cut(pairs.join(ids.withColumnRenamed("idx", "a"), "a", "left_semi").join(ids.withColumnRenamed("idx", "b"), "b", "left_semi"))
    many = {r["type"]: r["n"] for r in pairs.groupBy("type").agg(F.count("*").alias("n")).collect()}
    if not many:
        raise ValueError("no active constraints")
    tied = cut(constraints.apply_must_link(points, pairs))
    final = cut(constraints.repair_cannot_link(tied, pairs))
    was = points.select("idx", F.col("label").alias("l0")).join(tied.select("idx", F.col("label").alias("l1")), "idx").join(final.select("idx", F.col("label").alias("l2")), "idx")
    moves = was.agg(F.count_if(F.expr("l0 <> l1")).alias("must"), F.count_if(F.expr("l1 <> l2")).alias("cannot")).first()
    labelled = cut(points.drop("label").join(final, "idx"))
    quality = cluster_quality(labelled).join(silhouette(labelled)).first()
    history = now.read("clustering_iterations")
    iteration = commands.next_iteration(history, session_id).first()[0]
    entry = store.spark.createDataFrame([(1, iteration, quality["n_clusters"], quality["noise_count"], quality["noise_rate"], quality["silhouette"], many.get("must-link", 0), many.get("cannot-link", 0), moves["must"] + moves["cannot"])], "id long, iteration int, n_clusters int, noise_count int, noise_rate double, silhouette double, must_link_pairs int, cannot_link_pairs int, points_moved int").withColumn("created_at", _now())
    rows = now.read("requirements").drop("cluster_id", "is_noise").join(labelled.select(F.col("idx").alias("id"), F.col("label").alias("cluster_id"), (F.col("label") == -1).alias("is_noise")), "id")
    session = session.withColumns({"total_clusters": F.lit(quality["n_clusters"]).cast("int"), "noise_count": F.lit(quality["noise_count"]).cast("int")})
    return now.commit(sessions=session, requirements=rows, clusters=_cluster_rows(labelled), clustering_iterations=now.append("clustering_iterations", entry))


def quality_history(now: Snapshot) -> DataFrame:
    return now.read("clustering_iterations").orderBy("iteration")


def store_dependencies(store: Snapshots, session_id: int, top_k: int = 8, threshold: float = 0.45, max_edges: int | None = 2000, vectors: DataFrame | None = None, embed=embed_hash) -> Snapshot:
    """Dependencies of a session's texts, in place of those from before: nodes with levels and edges, by row."""
    now = store.open(session_id)
    _done(now)
    nodes, edges = dependency.dependency_tree(_points(now, vectors, embed), top_k, threshold, max_edges)
    return now.commit(
        dependency_nodes=nodes.select(F.col("idx").alias("requirement_id"), F.col("req_id").alias("node_id"), F.col("label").alias("cluster_id"), "level"),
        dependency_edges=edges.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation", "weight"))


def vectors_of(rows: DataFrame) -> DataFrame:
    """(id, embedding) as the commands take them."""
    return rows.select(F.col("idx").alias("id"), "embedding")


__all__ = ["cluster_session", "create", "decide_suggestion", "enrich_session", "quality_history", "recluster", "state_at", "store_dependencies", "store_suggestions", "submit_correction", "vectors_of"]
